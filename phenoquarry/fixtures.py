"""Relations derived from the driver's tables: the same text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DETECTIONS = """
select i as det_id, page_id, class_id,
       case when class_id = 1 then 'spikelet' else 'awn' end as class_name,
       tile_id, conf as confidence,
       (tile_id % 2)*320.0e0 as tx1, floor(tile_id/2)*320.0e0 as ty1,
       x as x1, y as y1, x + w as x2, y + h as y2
from (select i, page_id, case when j % 4 = 0 then 1 else 0 end as class_id,
             cast((j + (i % 2)*(j % 3)) % 4 as int) as tile_id,
             ((i*7919) % 1000)/1000.0e0 as conf,
             ((j*37) % 900 + (i % 2)*(j % 7))*1.0e0 as x,
             ((j*91) % 600 + (i % 2)*(j % 5))*1.0e0 as y,
             case when j % 4 = 0 then 40.0e0 + j % 30 else 7.0e0 + j % 9 end as w,
             case when j % 4 = 0 then 90.0e0 + j % 50 else 60.0e0 + j % 120 end as h
      from (select event_id as i, cast(floor(event_id/2) as bigint) as j,
                   cast(floor(event_id/200) as bigint) as page_id from events) a) b
"""

PATHS = """
select user_id as path_id,
       cast(row_number() over (partition by user_id order by ts, event_id) as int) as seq,
       cast(row_number() over (partition by user_id order by ts, event_id) as double) as x,
       value as y
from events
"""

SOURCE_PAGES = """
select o_orderkey as page_id,
       3508 - cast(o_orderkey % 2 as int)*1588 as width,
       2480 - cast(o_orderkey % 2 as int)*1400 as height,
       case when o_orderkey % 3 = 0 then null else 0.05e0 + (o_orderkey % 7)*0.01e0 end as mm_per_px,
       o_orderkey % 11 = 0 as demo
from orders
"""

RESULTS = """
select distinct l_orderkey*1000000 + l_partkey*10 + l_linenumber as result_id,
       l_orderkey as source_page_id,
       case when l_partkey % 2 = 0 then 'm0' else 'm1' end as model_id,
       l_linenumber as ordinal
from lineitem where l_orderkey % 4 <> 0
"""

#: Growth steps: one row for a hop of a spikelet's winning branch.
STEPS = """
select spikelet_id, cast(row_number() over (partition by spikelet_id order by k) as int) as hop,
       (k % 100)/100.0e0 as support_confidence, (k % 17)/10.0e0 as distance_mm,
       (k % 23)*1.0e0 as join_local_turn_deg, (k % 9)*1.0e0 as join_excess_turn_deg,
       (k % 31)*2.0e0 as join_angle_deg, (k % 13)/4.0e0 as extension_mm
from (select distinct l_orderkey as spikelet_id, l_partkey*10 + l_linenumber as k from lineitem) s
"""

#: Candidate seeds of a spikelet, with a total order (support_id).
SEEDS = """
select spikelet_id, support_id, case when k % 3 = 0 then 'direct' else 'projected' end as mode,
       (k % 41)/10.0e0 as root_distance_mm, (k % 13)/10.0e0 as projection_distance_mm,
       (k % 37)/37.0e0 as confidence, 0.2e0 + (k % 60)/2.0e0 as length_mm, (k % 90)*1.0e0 as axis_deviation_deg
from (select distinct l_orderkey as spikelet_id, l_partkey*10 + l_linenumber as support_id, l_partkey*7 + l_linenumber as k from lineitem) s
"""

#: Names as users type them, with leading signs and quotes.
NAMES = """
select p_partkey as name_id,
       case when p_partkey % 5 = 0 then '=' || p_name when p_partkey % 5 = 1 then '  +' || p_name
            when p_partkey % 5 = 2 then '@"' || p_name || '"' when p_partkey % 5 = 3 then p_name || '-' else p_name end as name,
       case when p_partkey % 4 = 0 then null else (p_partkey % 977)/8.0e0 end as length_mm
from part
"""

ALL = {"fx_detections": DETECTIONS, "fx_paths": PATHS, "fx_source_pages": SOURCE_PAGES, "fx_results": RESULTS, "fx_steps": STEPS, "fx_seeds": SEEDS, "fx_names": NAMES}
_BASE = {"fx_detections": "events", "fx_paths": "events", "fx_source_pages": "orders", "fx_results": "lineitem", "fx_steps": "lineitem", "fx_seeds": "lineitem", "fx_names": "part"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a lazy DataFrame, without touching the session's catalog."""
    base = _BASE[name]
    return spark.sql(ALL[name].replace(f"from {base}", f"from {{{base}}}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def ctes(*names: str) -> str:
    """The opening of a DuckDB query that defines the relations."""
    return "with " + ", ".join(f"{n} as ({ALL[n]})" for n in names)
