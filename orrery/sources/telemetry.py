"""Flow logs: inferred edges between hosts that talked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BASELINE_CONFIDENCE, INFERRED

FLOWS = "srcaddr string, dstaddr string, srcport int, dstport int, protocol int, action string, start long, end long"


def address_map(cis: DataFrame) -> DataFrame:
    """(ip, external_id) of open hosts; of hosts that share an address the smallest external_id."""
    ip = F.get_json_object("attributes", "$.private_ip")
    return cis.where("type = 'ec2_instance' and valid_to is null").select(ip.alias("ip"), "external_id").where("ip is not null").groupBy("ip").agg(F.min("external_id").alias("external_id"))


def flow_edges(flows: DataFrame, addresses: DataFrame, order: str = "start") -> DataFrame:
    """Discovered CONNECTS_TO edges, one for each ordered pair of known hosts with accepted traffic, with the evidence of the
    first record by `order`, then start and end."""
    known = lambda end: addresses.select(F.col("ip").alias(f"{end}addr"), F.col("external_id").alias(f"{end}_ext"))
    hit = flows.where("action = 'ACCEPT'").join(known("src"), "srcaddr").join(known("dst"), "dstaddr")
    first = F.row_number().over(Window.partitionBy("src_ext", "dst_ext").orderBy(order, "start", "end", "srcport", "dstport"))
    one = hit.withColumn("_n", first).where("_n = 1")
    detail = F.format_string("%s:%d -> %s:%d proto=%d", "srcaddr", "srcport", "dstaddr", "dstport", "protocol")
    evidence = F.array(F.struct(F.lit("aws-flowlogs").alias("source"), F.timestamp_seconds("end").alias("observed_at"), detail.alias("detail")))
    return one.select(
        F.lit("CONNECTS_TO").alias("type"), F.lit("ec2_instance").alias("from_type"), F.col("src_ext").alias("from_ext"), F.lit("ec2_instance").alias("to_type"), F.col("dst_ext").alias("to_ext"),
        F.lit(INFERRED).alias("source"), F.lit(BASELINE_CONFIDENCE).alias("confidence"), evidence.alias("evidence"), F.lit("").alias("edge_key"),
    )


def malformed(flows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Accepted records of known hosts without ports, protocol or end: they are to be set aside, not read."""
    ips = addresses.select("ip")
    hit = flows.where("action = 'ACCEPT'").join(ips.withColumnRenamed("ip", "srcaddr"), "srcaddr", "left_semi").join(ips.withColumnRenamed("ip", "dstaddr"), "dstaddr", "left_semi")
    return hit.where("srcport is null or dstport is null or protocol is null or end is null")
