"""Loaders of the documents around fragments, with explicit schemas and no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions.names import is_sha256

INDEX = "map<string,struct<file:string,sha256:string,size:bigint,body_offset:bigint,experts:map<string,array<bigint>>>>"
POLICY = "schema string, bits_per_expert map<string,array<int>>"
ENVELOPE = "payload string, signature string, keyid string"
PAYLOAD = (
    "schema string, predicate string, fragment struct<file:string,sha256:string,size:bigint,header_sha256:string,body_offset:bigint>, expert_sha256 map<string,string>, "
    "created_utc string, layer int, k int, layout string, base_model string, num_experts int, materials map<string,string>"
)
RELEASE = "schema string, release string, created_utc string, counts struct<files:bigint,fragments:bigint,bytes:bigint>, files map<string,struct<sha256:string,size:bigint>>"
EPS = "layer int, bits int, expert_rel_rt_mse array<double>, expert_routed_count array<bigint>"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path, value of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def index(spark: SparkSession, path: str) -> DataFrame:
    """layer, k, file, sha256, size, body_offset, expert, lo, hi: a row per expert span."""
    rows = whole(spark, path).withColumn("k", F.regexp_extract("path", r"index-k(\d+)\.json$", 1).cast("int"))
    rows = rows.select("k", F.explode(F.from_json("value", INDEX)).alias("layer", "s"))
    rows = rows.select(F.col("layer").cast("int").alias("layer"), "k", "s.*")
    return rows.select("layer", "k", "file", "sha256", "size", "body_offset", F.explode("experts").alias("expert", "span")).select(
        "layer", "k", "file", "sha256", "size", "body_offset", F.col("expert").cast("int").alias("expert"), F.col("span")[0].alias("lo"), F.col("span")[1].alias("hi")
    )


def policy(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """layer, expert, k; a missing map, or a layer without a list of integers, is an error."""
    bits = F.coalesce(F.from_json("value", POLICY)["bits_per_expert"], F.raise_error(F.lit("no bits_per_expert")).cast("map<string,array<int>>"))
    rows = whole(spark, path).select(F.explode(bits).alias("layer", "bits")).withColumn("layer", F.col("layer").cast("int"))
    if layers is not None:
        rows = rows.where(F.col("layer").isin(layers))
    bad = F.coalesce(F.size("bits") <= 0, F.lit(True)) | F.exists(F.coalesce("bits", F.array(F.lit(0))), lambda x: F.coalesce(~x.between(1, 16), F.lit(True)))
    rows = rows.withColumn("bits", F.when(bad, F.raise_error(F.lit("bad policy")).cast("array<int>")).otherwise(F.col("bits")))
    return rows.select("layer", F.posexplode("bits").alias("expert", "k"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of every line that isn't blank, in file order."""
    return whole(spark, path).select(F.col("path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def attestations(spark: SparkSession, path: str) -> DataFrame:
    """Undecided lines with their claimed payload; nothing here is verified."""
    rows = lines(spark, path).withColumn("e", F.from_json("line", ENVELOPE))
    return rows.withColumn("claim", F.from_json(F.decode(F.try_to_binary("e.payload", F.lit("base64")), "UTF-8"), PAYLOAD)).select("file", "line_no", "line", "e.keyid", "claim")


def provider_map(spark: SparkSession, path: str) -> DataFrame:
    """scope (default, layer or expert), layer, expert, provider."""
    m = F.from_json("value", "default string, layers map<string,string>, experts map<string,map<string,string>>")
    rows = whole(spark, path).select(m.alias("m"))
    none = F.lit(None).cast("int")
    a = rows.select(F.lit("default").alias("scope"), none.alias("layer"), none.alias("expert"), F.col("m.default").alias("provider"))
    b = rows.select(F.explode("m.layers").alias("l", "provider")).select(F.lit("layer"), F.col("l").cast("int"), none, "provider")
    c = rows.select(F.explode("m.experts").alias("l", "x")).select("l", F.explode("x").alias("e", "provider")).select(F.lit("expert"), F.col("l").cast("int"), F.col("e").cast("int"), "provider")
    return a.where("provider is not null").union(b).union(c)


def release(spark: SparkSession, path: str) -> DataFrame:
    """release, path, sha256, size."""
    r = whole(spark, path).select(F.from_json("value", RELEASE).alias("r"))
    return r.select("r.release", F.explode("r.files").alias("path", "f")).select("release", "path", "f.sha256", "f.size")


def sums(spark: SparkSession, path: str) -> DataFrame:
    """sha256, path of lines with exactly two fields; other lines don't count."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("sha256"), parts[1].alias("path"))


def trust_root(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, key_id, status, added, role of lines that begin with a fingerprint and have three fields or
    more, later ones empty where they are absent; # begins a comment; other lines don't count here."""
    return trust_lines(spark.read.text(path))


def trust_lines(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    rows = lines.where((F.size(parts) >= 3) & is_sha256(parts[0]))
    return rows.select(*(F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(("fingerprint", "key_id", "status", "added", "role"))))


BINDING = "fetch_binding struct<schema:string,providers:struct<schema:string>,content:struct<manifests:map<string,string>,experts:map<string,map<string,string>>>>"


def fetch_binding(spark: SparkSession, path: str, binding_schema: str, select_schema: str) -> DataFrame:
    """layer, expert, sha256 that a recipe binds, and the manifests' digests as rows without an expert (provider,
    sha256). A recipe without a binding has no rows; one of another shape is an error."""
    b = F.from_json("value", BINDING)["fetch_binding"]
    rows = whole(spark, path).select(b.alias("b"), F.get_json_object("value", "$.fetch_binding").isNotNull().alias("there"))
    good = (F.col("b.schema") == binding_schema) & (F.col("b.providers.schema") == select_schema) & F.col("b.content.manifests").isNotNull() & F.col("b.content.experts").isNotNull()
    checked = F.when(F.col("there"), F.when(F.coalesce(good, F.lit(False)), F.col("b.content")).otherwise(F.raise_error(F.lit("bad fetch binding"))))
    rows = rows.select(checked.alias("c"))
    none = F.lit(None)
    experts = rows.select(F.explode("c.experts").alias("layer", "e")).select("layer", F.explode("e").alias("expert", "sha256"))
    experts = experts.select(F.col("layer").cast("int"), F.col("expert").cast("int"), none.cast("string").alias("provider"), "sha256")
    return experts.union(rows.select(F.explode("c.manifests").alias("provider", "sha256")).select(none.cast("int"), none.cast("int"), "provider", "sha256"))


def side_metadata(spark: SparkSession, folder: str, tail_key: str, keys: list[str]) -> DataFrame:
    """One row: of a source's config the given keys of its object tail_key, its tier bitmap and the digest of its corpus; what
    isn't there is NULL."""
    text = whole(spark, f"{folder.rstrip('/')}/*.json").withColumn("name", F.substring_index("path", "/", -1))
    one = text.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(a) for n, a in (("config.json", "c"), ("tier_bitmap.json", "t"), ("calibration_manifest.json", "m"))))
    tail = F.from_json(F.get_json_object("c", f"$.{tail_key}"), "map<string,string>")
    return one.select(F.map_filter(tail, lambda k, v: k.isin(keys)).alias("config"), F.from_json("t", "map<string,struct<k:array<int>>>").alias("bitmap"), F.get_json_object("m", "$.corpus_sha256").alias("corpus_sha256"))


def remote_listing(answers: DataFrame) -> DataFrame:
    """path, size, lfs, blob of a hub's answers (value: a JSON object whose siblings have rfilename, size, blob_id and
    lfs), one or many pages."""
    file = "struct<rfilename:string,size:bigint,blob_id:string,lfs:struct<sha256:string>>"
    rows = answers.select(F.explode(F.from_json("value", f"siblings array<{file}>")["siblings"]).alias("f"))
    return rows.select(F.col("f.rfilename").alias("path"), "f.size", F.col("f.lfs.sha256").alias("lfs"), F.col("f.blob_id").alias("blob"))


def eps(spark: SparkSession, path: str) -> DataFrame:
    """k, layer, expert, eps, phi of finished work files."""
    rows = spark.read.schema(EPS).json(path, multiLine=True)
    zipped = F.posexplode(F.arrays_zip("expert_rel_rt_mse", "expert_routed_count")).alias("expert", "x")
    return rows.select(F.col("bits").alias("k"), "layer", zipped).select("k", "layer", "expert", F.col("x.expert_rel_rt_mse").alias("eps"), F.col("x.expert_routed_count").alias("phi"))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, mtime, content of all files below a folder; content isn't read unless it is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/") + "/"
    return rows.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
