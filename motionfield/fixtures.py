"""Views that read the given tables as thumbs, pixels, pairs, zones, an image bank, points and spines.

Each view is one SQL text for Spark and DuckDB: ``//`` is integer division,
``DAY(x)`` a date as text, ``{name}`` another view or a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Grid of the rasters: origin and pixel size.
X0, Y0, PX, PY = 0.0, 64.0, 2.0, -2.0
SIZE = 32

VIEWS = {
    "thumb_files": """
        SELECT DISTINCT th_valid, concat('/bank/', pz, '/opticals/', pz, '_', th_date, '_', sensor, ext) AS th_path FROM (
          SELECT CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS th_valid,
            CASE WHEN o_orderkey % 11 = 0 THEN concat('pz_', CAST(o_custkey AS STRING)) ELSE concat('pz', CAST(o_custkey AS STRING)) END AS pz,
            DAY(o_orderdate) AS th_date, CASE o_orderkey % 3 WHEN 0 THEN 'spot6' WHEN 1 THEN 'SPOT7' ELSE 'aerial' END AS sensor,
            CASE WHEN o_orderkey % 7 = 0 THEN '.jpg' WHEN o_orderkey % 5 = 0 THEN '.TIF' ELSE '.tif' END AS ext
          FROM {orders}) AS t""",
    "pix": """
        SELECT CAST(event_id // 1024 AS INT) AS raster_id, CAST((event_id % 1024) // 32 AS INT) AS row, CAST(event_id % 32 AS INT) AS col,
          (value - 50) / CAST(10 AS DOUBLE) AS dx, (user_id % 21 - 10) / CAST(2 AS DOUBLE) AS dy, ((event_id * 7919) % 1000) / CAST(1000 AS DOUBLE) AS cc,
          CASE WHEN ((event_id % 1024) // 32 - 16) * ((event_id % 1024) // 32 - 16) + (event_id % 32 - 16) * (event_id % 32 - 16) < (6 + (event_id // 1024) % 8) * (6 + (event_id // 1024) % 8)
            THEN CASE WHEN user_id % 17 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END END AS label,
          CAST(2 * (event_id % 32) + 1 AS DOUBLE) AS x, CAST(63 - 2 * ((event_id % 1024) // 32) AS DOUBLE) AS y
        FROM {events}""",
    # rasters of 320 columns, larger than the default boxes
    "wide": """
        SELECT CAST(event_id // 102400 AS INT) AS raster_id, CAST((event_id % 102400) // 320 AS INT) AS row, CAST(event_id % 320 AS INT) AS col,
          CASE WHEN ((event_id % 102400) // 320 - 100) * ((event_id % 102400) // 320 - 100) + (event_id % 320 - 160) * (event_id % 320 - 160) < 14400 THEN CASE WHEN user_id % 97 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END END AS label
        FROM {events}""",
    "pair_meta": """
        SELECT raster_id, concat('pz', CAST(raster_id % 12 AS STRING)) AS pz_name, CAST(2000 + raster_id % 7 AS INT) AS left_year, CAST(2000 + (3 * raster_id + 1) % 7 AS INT) AS right_year,
          CASE raster_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'clipped' WHEN 2 THEN 'complete' ELSE 'empty' END AS pa_status
        FROM (SELECT DISTINCT CAST(event_id // 1024 AS INT) AS raster_id FROM {events}) AS r""",
    "zone_centres": """
        SELECT n_nationkey AS zone_id, CAST(8.37 AS DOUBLE) + (13 * n_nationkey) % 48 AS cx, CAST(8.41 AS DOUBLE) + (29 * n_nationkey) % 48 AS cy FROM {nation}""",
    "zone_edges": """
        SELECT zone_id, cx - 6 AS x1, cy - 5 AS y1, cx + 7 AS x2, cy - 4 AS y2 FROM {zone_centres} AS a UNION ALL SELECT zone_id, cx + 7, cy - 4, cx + 1, cy + 8 FROM {zone_centres} AS b
        UNION ALL SELECT zone_id, cx + 1, cy + 8, cx - 6, cy - 5 FROM {zone_centres} AS c""",
    "zones": """
        SELECT n_nationkey AS zone_id, concat('pz', CAST(n_nationkey % 12 AS STRING)) AS ge_pz_name, concat('GE', CAST(n_nationkey AS STRING)) AS ge_frogi_id FROM {nation}
        UNION ALL SELECT n_nationkey, concat('pz', CAST(n_nationkey % 12 AS STRING)), concat('GE', CAST(n_nationkey AS STRING)) FROM {nation} WHERE n_nationkey = 3""",
    "bank_files": """
        SELECT event_id, concat('/bank/', CASE event_id % 5
            WHEN 0 THEN concat('aerial/img-', CAST(2000 + event_id % 20 AS STRING), '0704-', CAST(event_id AS STRING), '.tif') WHEN 1 THEN concat('spot6/s', CAST(event_id AS STRING), '.JP2')
            WHEN 2 THEN concat('x/swissimage_', CAST(2000 + event_id % 20 AS STRING), '_', CAST(event_id AS STRING), '.tif') WHEN 3 THEN concat('other/u', CAST(event_id AS STRING), '.tif')
            ELSE concat('other/p', CAST(event_id AS STRING), '.png') END) AS filepath
        FROM {events}""",
    "bank_headers": """
        SELECT b.filepath, CAST((event_id * 7) % 60 AS DOUBLE) AS x0, CAST(4 + (event_id * 11) % 60 AS DOUBLE) AS y0, CASE WHEN event_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS px,
          CASE WHEN event_id % 2 = 0 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS py, CAST(1 + event_id % 3 AS INT) AS bands,
          CAST(CASE WHEN event_id % 2 = 0 THEN 8 ELSE 4 END AS INT) AS n_rows, CAST(CASE WHEN event_id % 2 = 0 THEN 8 ELSE 4 END AS INT) AS n_cols
        FROM {bank_files} AS b""",
    "bank_xml": """
        SELECT filepath, concat('<Doc><IMAGING_DATE>', CAST(2000 + event_id % 20 AS STRING), '-06-01</IMAGING_DATE></Doc>') AS xml FROM {bank_files} AS b WHERE event_id % 5 = 1 AND event_id % 3 <> 0""",
    "points": """
        SELECT c_custkey AS point_id, ((c_custkey * 37) % 660) / CAST(10 AS DOUBLE) - 1 + CAST(0.03 AS DOUBLE) AS x, ((c_custkey * 53) % 660) / CAST(10 AS DOUBLE) - 1 + CAST(0.03 AS DOUBLE) AS y FROM {customer}""",
    "spines": """
        SELECT concat('SP', CAST(s_suppkey AS STRING)) AS sp_id, concat('GE', CAST(s_suppkey % 25 AS STRING)) AS sp_ge_id, concat('pz', CAST(s_suppkey % 12 AS STRING)) AS sp_pz_name,
          CAST(9 AS DOUBLE) AS sp_ri_len, CAST(5 AS DOUBLE) AS sp_ri_step, 'v' AS sp_ri_or,
          CAST(10.3 AS DOUBLE) + s_suppkey % 20 AS ax, CAST(12.7 AS DOUBLE) AS ay, CAST(40.1 AS DOUBLE) AS bx, CAST(30.2 AS DOUBLE) + s_suppkey % 20 AS by2 FROM {supplier}""",
    "artifacts": """
        SELECT raster_id, kind FROM (
          SELECT raster_id, 'folder' AS kind FROM {pair_meta} AS a WHERE raster_id % 5 <> 4 UNION ALL SELECT raster_id, 'inputs' FROM {pair_meta} AS b WHERE raster_id % 3 = 0 AND raster_id % 5 <> 4
          UNION ALL SELECT raster_id, 'dispf' FROM {pair_meta} AS c WHERE raster_id % 2 = 0 AND raster_id % 5 <> 4) AS t""",
    "match_pairs": """
        SELECT l.raster_id AS pair_id, l.row, l.col, l.dx AS lv, r.dx AS rv FROM {pix} AS l
        JOIN {pix} AS r ON r.raster_id = l.raster_id AND r.row = l.row - (l.raster_id % 3 - 1) AND r.col = l.col - ((l.raster_id + 1) % 3 - 1)""",
    "tiles": "SELECT vec_id, embedding FROM {embeddings}",
}


def _names(sql: str) -> list[str]:
    return re.findall(r"{([a-z]\w*)}", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"DAY\((\w+)\)", r"date_format(\1, 'yyyy-MM-dd')", VIEWS[name])
    # integer division, outside of quoted text
    sql = "'".join(part if k % 2 else part.replace("//", "div") for k, part in enumerate(sql.split("'")))
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _names(sql)})


def with_views(sql: str) -> str:
    """A DuckDB query with the views that it names in braces as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _names(VIEWS[name]):
                add(n)
            order.append(name)

    for n in _names(sql):
        add(n)
    text = lambda s: re.sub(r"{([a-z]\w*)}", r"\1", re.sub(r"DAY\((\w+)\)", r"strftime(\1, '%Y-%m-%d')", s))
    parts = [f"{n} AS MATERIALIZED ({text(VIEWS[n])})" for n in order]
    body = text(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*parts, body[len("WITH RECURSIVE") :].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:].strip()])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
