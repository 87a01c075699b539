"""The given tables, and views of them in the shape of a facility and program catalog.

`VIEWS` holds the same views as SQL text, for oracles; the frames are built with the DataFrame API.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "facility": """select cast(s_suppkey as bigint) as code, s_name as name, n_name as state, r_name as country, (s_suppkey % 5 <> 0) as approved, (s_suppkey % 3 = 0) as is_employer, (s_suppkey % 3 <> 0) as is_school,
 case when s_suppkey % 17 = 0 then cast(null as double) else 25.0e0 + cast((s_suppkey*7919) % 2400 as double)/100 end as lat,
 case when s_suppkey % 17 = 0 then cast(null as double) else -124.0e0 + cast((s_suppkey*104729) % 5700 as double)/100 end as lon,
 lpad(cast((s_suppkey*7919) % 100000 as varchar(10)),5,'0') as zip, s_acctbal as rate
 from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "program": "select distinct cast(l_suppkey as bigint) as code, p_type as ptype, concat(p_name,' ',lower(p_brand)) as description from lineitem join part on l_partkey=p_partkey",
    "zcta": "select lpad(cast((c_custkey*613) % 100000 as varchar(10)),5,'0') as zip, min(25.0e0 + cast((c_custkey*7919) % 2400 as double)/100) as lat, min(-124.0e0 + cast((c_custkey*104729) % 5700 as double)/100) as lon from customer group by 1",
    "triples": """select concat('n/',cast(n_nationkey as varchar(10))) as s, 'inRegion' as p, concat('r/',cast(n_regionkey as varchar(10))) as o from nation union all select concat('n/',cast(n_nationkey as varchar(10))), 'title', n_name from nation union all select concat('s/',cast(s_suppkey as varchar(10))), 'inNation', concat('n/',cast(s_nationkey as varchar(10))) from supplier union all select concat('s/',cast(s_suppkey as varchar(10))), 'name', s_name from supplier union all select concat('r/',cast(r_regionkey as varchar(10))), 'title', r_name from region""",
    "crosswalk": "select distinct p_brand as cip, p_type as soc from part",
    "completions": "select cast(l_suppkey as bigint) as unitid, p_brand as cip, cast(l_linenumber as int) as awlevel, cast(count(*) as bigint) as awards from lineitem join part on l_partkey=p_partkey group by 1,2,3",
    "cache_log": "select cast(user_id as bigint) as cache_key, min(ts) as created_at, max(ts) as accessed_at from events group by user_id",
}


class Tables:
    """Lazily read tables and views: `t.orders`, `t.facility`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def facility(self) -> DataFrame:
        key = F.col("s_suppkey")
        located = key % 17 != 0
        rows = self.supplier.join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(
            key.cast("bigint").alias("code"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("country"),
            (key % 5 != 0).alias("approved"),
            (key % 3 == 0).alias("is_employer"),
            (key % 3 != 0).alias("is_school"),
            F.when(located, 25.0 + ((key * 7919) % 2400).cast("double") / 100).alias("lat"),
            F.when(located, -124.0 + ((key * 104729) % 5700).cast("double") / 100).alias("lon"),
            F.lpad(((key * 7919) % 100000).cast("string"), 5, "0").alias("zip"),
            F.col("s_acctbal").alias("rate"),
        )

    @cached_property
    def program(self) -> DataFrame:
        """Each part stands for all of its type and description: lines are dealt as pairs of numbers, and
        the texts meet them when they are distinct."""
        parts = self.part.select("p_partkey", F.col("p_type").alias("ptype"), F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("description"))
        kinds = parts.groupBy("ptype", "description").agg(F.min("p_partkey").alias("kind"))
        of = parts.join(kinds, parts["ptype"].eqNullSafe(kinds["ptype"]) & parts["description"].eqNullSafe(kinds["description"])).select("p_partkey", "kind")
        sold = self.lineitem.join(of, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").cast("bigint").alias("code"), "kind").distinct()
        return sold.join(kinds, "kind").select("code", "ptype", "description")

    @cached_property
    def described(self) -> DataFrame:
        """The program view's descriptions, each once: those of parts that any line sells."""
        sold = self.part.join(self.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
        return sold.select(F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("description")).distinct()

    @cached_property
    def zcta(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customer.groupBy(F.lpad(((key * 613) % 100000).cast("string"), 5, "0").alias("zip")).agg(
            F.min(25.0 + ((key * 7919) % 2400).cast("double") / 100).alias("lat"), F.min(-124.0 + ((key * 104729) % 5700).cast("double") / 100).alias("lon")
        )

    @cached_property
    def triples(self) -> DataFrame:
        def part(frame: DataFrame, kind: str, key: str, p: str, o) -> DataFrame:
            return frame.select(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("s"), F.lit(p).alias("p"), o.alias("o"))

        iri = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
        n, s, r = self.nation, self.supplier, self.region
        return (
            part(n, "n", "n_nationkey", "inRegion", iri("r", "n_regionkey"))
            .unionByName(part(n, "n", "n_nationkey", "title", F.col("n_name")))
            .unionByName(part(s, "s", "s_suppkey", "inNation", iri("n", "s_nationkey")))
            .unionByName(part(s, "s", "s_suppkey", "name", F.col("s_name")))
            .unionByName(part(r, "r", "r_regionkey", "title", F.col("r_name")))
        )

    @cached_property
    def crosswalk(self) -> DataFrame:
        return self.part.select(F.col("p_brand").alias("cip"), F.col("p_type").alias("soc")).distinct()

    @cached_property
    def completions(self) -> DataFrame:
        rows = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy(F.col("l_suppkey").cast("bigint").alias("unitid"), F.col("p_brand").alias("cip"), F.col("l_linenumber").cast("int").alias("awlevel")).agg(F.count("*").alias("awards"))

    @cached_property
    def cache_log(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").cast("bigint").alias("cache_key")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("accessed_at"))
