"""Schemas of the stored tables.  Geometries are plain columns: an extent struct, rings and lines as arrays of points."""

POINT = "struct<x: double, y: double>"
EXTENT = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"

THUMBS = f"th_pz_name string, th_path string, th_sensor string, th_date string, th_year int, th_valid string, extent {EXTENT}, epsg int"
PAIRS = "pa_pz_name string, pa_path string, pa_left_date string, pa_left_sensor string, pa_right_date string, pa_right_sensor string, pa_magn_path string, pa_dispf_path string, pa_snr_path string, pa_status string, " + f"extent {EXTENT}, epsg int"
PZONES = f"pz_name string, ring array<{POINT}>, epsg int"
GEOMORPHS = f"ge_frogi_id string, ge_pz_name string, ring array<{POINT}>, epsg int"
XZONES = f"xz_id string, xz_pz_name string, ring array<{POINT}>, epsg int"
SPINES = f"sp_id string, sp_ge_id string, sp_pz_name string, sp_ri_len double, sp_ri_step double, sp_ri_or string, line array<{POINT}>, epsg int"
LAYERS = {"thumbs": THUMBS, "pairs": PAIRS, "pzones": PZONES, "geomorphs": GEOMORPHS, "xzones": XZONES, "spines": SPINES}
