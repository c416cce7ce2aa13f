"""Exactly-once requests out of an at-least-once topic.

Identifiers of one time bucket form a Bloom filter of 64-bit words. A word is
one row ``(time bucket, block, bits)`` made by ``bit_or``, so filters are built,
merged and probed inside ordinary aggregates and windows. An identifier whose
bits no earlier and no later bucket holds, and that its own bucket holds once,
is new without any doubt; only the rest is compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.components import connected_components
from siltstone.operators.skew import lookup_join
from siltstone.session import stage

#: Identifiers per 64-bit filter word; four bits are set for each.
IDS_PER_WORD = 4
SEP = "\x01"


def uuid_key(col: Column) -> Column:
    """32 lower-case hex digits of a UUID however it is spelled; NULL for anything else."""
    bare = F.regexp_replace(F.lower(col), r"^[\s\p{Z}{(]*(?:urn:)?(?:uuid:)?|[\s\p{Z})}-]", "")
    bare = F.regexp_replace(bare, r"[{}]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def commit_key(col: Column) -> Column:
    """Lower-case hex digits of a commit; NULL where missing, empty, all zero or not a hash."""
    bare = F.regexp_replace(F.lower(col), r"[\s\p{Z}]", "")
    return F.when(bare.rlike("^[0-9a-f]{7,64}$") & ~bare.rlike("^0+$"), bare)


def _resolve_abbreviations(rows: DataFrame) -> DataFrame:
    """Give an abbreviated hash and the full one of the same repo and request the same key.

    An abbreviation that starts several full hashes of its request denotes none
    of them for sure and stands for itself.
    """
    place = F.concat_ws(SEP, "repo", F.col("pr_number").cast("string"))
    commits = (
        rows.where("sha is not null and repo is not null and pr_number is not null")
        .select(place.alias("place"), "sha", F.substring("sha", 1, 7).alias("head"))
        .distinct()
    )
    short = commits.where(F.length("sha") < 40).select("place", "head", F.col("sha").alias("short"))
    longer = commits.join(short, ["place", "head"]).where(F.col("sha").startswith(F.col("short")) & (F.col("sha") != F.col("short")))
    clear = longer.groupBy("place", "short").agg(F.count_if(F.length("sha") >= 40).alias("n")).where("n <= 1").select("place", "short")
    roots = (
        longer.join(clear, ["place", "short"])
        .groupBy("place", "sha")
        .agg(F.min_by("short", F.length("short")).alias("root"))
        .select(F.concat_ws(SEP, "place", "sha").alias("commit"), F.concat_ws(SEP, "place", "root").alias("root"))
    )
    keyed = rows.withColumn(
        "commit",
        F.when(
            F.col("sha").isNotNull() & F.col("repo").isNotNull() & F.col("pr_number").isNotNull(),
            F.concat_ws(SEP, place, "sha"),
        ),
    )
    return lookup_join(keyed, roots, "commit", "left").withColumn("commit", F.coalesce("root", "commit")).drop("root")


def screen_identifiers(seen: DataFrame, n_blocks: int) -> DataFrame:
    """Flag each ``(ident, bucket, n)`` that the Bloom filters can't prove to be new.

    ``seen`` has one row per identifier and time bucket. The filters of all
    earlier and of all later buckets are running ``bit_or`` values within a
    filter block; one shuffle by block does all probes.
    """
    hashed = (
        seen.withColumn("block", F.pmod(F.xxhash64("ident"), F.lit(n_blocks)))
        .withColumn("h2", F.xxhash64(F.lit("mask"), "ident"))
        .withColumn("mask", _mask())
    )
    w = Window.partitionBy("block").orderBy("bucket")
    before = F.bit_or("mask").over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.bit_or("mask").over(w.rangeBetween(1, Window.unboundedFollowing))
    held = lambda c: F.coalesce(c.bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return (
        hashed.withColumn("before", before)
        .withColumn("after", after)
        .withColumn("maybe", (F.col("n") > 1) | held(F.col("before")) | held(F.col("after")))
        .drop("h2", "before", "after")
    )


def _mask() -> Column:
    bit = lambda i: F.expr(f"shiftleft(1L, cast(pmod(shiftright(h2, {6 * i}), 64) as int))")
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


@dataclass
class IdentifierStore:
    """Identifiers met so far, in a folder per time bucket, with a Bloom filter for each.

    A batch is screened by the filters alone; what they can't call new is
    looked up exactly, in the folders of the buckets that matched and no
    others. Filters of 2**``bits`` words of 64 bits hold about four identifiers
    a word; more only raise the share that is looked up.
    """

    spark: SparkSession
    root: str
    bits: int = 16

    def _hashed(self, idents: DataFrame) -> DataFrame:
        return idents.where("ident is not null").withColumn("block", F.pmod(F.xxhash64("ident"), F.lit(1 << self.bits))).withColumn("h2", F.xxhash64(F.lit("mask"), "ident")).withColumn("mask", _mask()).drop("h2")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def add(self, idents: DataFrame) -> None:
        """Store a batch (ident, bucket); one that is stored twice changes nothing."""
        rows = self._hashed(idents.select("ident", "bucket").distinct())
        rows.select("ident", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/idents")
        rows.groupBy("bucket", "block").agg(F.bit_or("mask").alias("word")).write.mode("append").partitionBy("bucket").parquet(f"{self.root}/filters")

    def maybe_seen(self, idents: DataFrame) -> DataFrame:
        """``ident, bucket``: identifiers of a batch (ident) and stored buckets whose filter holds them."""
        words = self._read("filters", "block long, word long, bucket int").groupBy("bucket", "block").agg(F.bit_or("word").alias("word"))
        asked = self._hashed(idents.select("ident").distinct())
        return asked.join(words, "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("ident", "bucket")

    def seen(self, idents: DataFrame) -> DataFrame:
        """``ident`` of a batch that are stored already. The buckets that matched are a list of days."""
        maybe = stage(self.maybe_seen(idents), "maybe-seen")
        buckets = [r[0] for r in maybe.select("bucket").distinct().collect()]
        stored = self._read("idents", "ident string, bucket int").where(F.col("bucket").isin(buckets))
        return maybe.join(stored, ["ident", "bucket"], "left_semi").select("ident").distinct()


def assign_requests(jobs: DataFrame, bucket: str = "received_at") -> DataFrame:
    """``delivery_id, request_id`` of every delivery; the request is its smallest delivery.

    Two deliveries are one request when their ``job_id`` denotes the same UUID,
    or when ``repo`` and ``pr_number`` are equal and ``head_sha`` denotes the
    same known commit (an abbreviated hash denotes the one it starts; one that
    starts several full hashes of its request denotes itself). This carries over. ``bucket`` is the time column whose day makes the buckets;
    NULL times form a bucket of their own.

    NULL or unreadable identifiers link nothing. A delivery without
    ``delivery_id`` can't be named and is left out. Rows repeated as a whole
    come out once. An empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    rows = jobs.where("delivery_id is not null").select(
        "delivery_id",
        "repo",
        "pr_number",
        uuid_key(F.col("job_id")).alias("job"),
        commit_key(F.col("head_sha")).alias("sha"),
        F.coalesce(F.datediff(F.col(bucket).cast("date"), F.lit("1970-01-01")), F.lit(-1_000_000)).alias("bucket"),
    )
    rows = stage(
        _resolve_abbreviations(rows).select(
            "delivery_id",
            "bucket",
            F.concat(F.lit("j"), "job").alias("job"),
            F.concat(F.lit("c"), F.sha2("commit", 256)).alias("commit"),
        ),
        "deliveries",
    )
    idents = rows.select("delivery_id", "bucket", F.explode(F.array("job", "commit")).alias("ident")).where(
        "ident is not null"
    )
    seen = stage(
        idents.groupBy("ident", "bucket").agg(F.min("delivery_id").alias("first"), F.count_distinct("delivery_id").alias("n")),
        "identifiers",
    )
    n_blocks = 1 << max(10, (max(1, seen.count()) // IDS_PER_WORD).bit_length())
    suspects = screen_identifiers(seen, n_blocks).where("maybe")
    repeated = stage(
        suspects.groupBy("ident").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    by_job = repeated.select(F.col("ident").alias("job"), F.col("first").alias("by_job"))
    by_commit = repeated.select(F.col("ident").alias("commit"), F.col("first").alias("by_commit"))
    named = stage(
        lookup_join(lookup_join(rows, by_job, "job", "left"), by_commit, "commit", "left").select(
            "delivery_id", "by_job", "by_commit", F.coalesce("by_job", "by_commit", "delivery_id").alias("node")
        ),
        "named",
    )
    links = named.where("by_job <> by_commit").select(F.col("by_job").alias("src"), F.col("by_commit").alias("dst")).distinct()
    found = connected_components(links)
    return (
        lookup_join(named, found, "node", "left")
        .select("delivery_id", F.coalesce("component", "node").alias("request_id"))
        .distinct()
    )


def unique_deliveries(jobs: DataFrame, bucket: str = "received_at") -> DataFrame:
    """The deliveries to keep, whole rows: exactly one of each request."""
    kept = assign_requests(jobs, bucket).where("delivery_id = request_id").select("delivery_id")
    return jobs.join(kept, "delivery_id", "left_semi").dropDuplicates(["delivery_id"])


def superfluous_deliveries(jobs: DataFrame, bucket: str = "received_at") -> DataFrame:
    """``delivery_id`` of every delivery that repeats an earlier one's request."""
    return assign_requests(jobs, bucket).where("delivery_id <> request_id").select("delivery_id")
