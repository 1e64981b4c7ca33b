"""Name grammar, canonical order, parsing and formatting, as column expressions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the on-disk name grammar.
TENSOR = r"^model\.layers\.(\d+)\.mlp\.experts\.(\d+)\.(\w+_proj)\.rank(\d+)\.(\w+)\z"
SHARED = r"^model\.layers\.(\d+)\.mlp\.experts\.shared_h\.(\w+_proj)\.rank(\d+)\.(suh|svh)\z"
PROJECTIONS = {"gate_proj": 0, "up_proj": 1, "down_proj": 2}
COMPONENTS = {"trellis": 0, "suh": 1, "svh": 2, "mcg": 3, "mul1": 3}


def _rank(column: Column, table: dict[str, int], what: str) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column)
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what} "), column)).cast("int"))


def with_tensor_key(df: DataFrame, name: str = "name") -> DataFrame:
    """layer, expert, proj, rank, comp and the canonical sort key of expert tensors; other names are left out.
    An unknown projection or component is an error."""
    df = df.where(F.col(name).rlike(TENSOR))
    part = [F.regexp_extract(name, TENSOR, i) for i in range(1, 6)]
    out = df.select("*", part[0].cast("int").alias("layer"), part[1].cast("int").alias("expert"), part[2].alias("proj"), part[3].cast("int").alias("rank"), part[4].alias("comp"))
    return out.withColumn("proj_ord", _rank(F.col("proj"), PROJECTIONS, "projection")).withColumn("comp_ord", _rank(F.col("comp"), COMPONENTS, "component"))


CANONICAL = ["expert", "proj_ord", "rank", "comp_ord", "name"]


def canonical_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*CANONICAL)


def with_shared_key(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows that all experts of a layer share, with their sort key."""
    df = df.where(F.col(name).rlike(SHARED))
    part = [F.regexp_extract(name, SHARED, i) for i in range(1, 5)]
    out = df.select("*", part[0].cast("int").alias("layer"), part[1].alias("proj"), part[2].cast("int").alias("rank"), part[3].alias("comp"))
    return out.withColumn("proj_ord", _rank(F.col("proj"), PROJECTIONS, "projection")).withColumn("comp_ord", _rank(F.col("comp"), COMPONENTS, "component"))


def tier_of_shape(shape: Column) -> Column:
    """K of a packed tensor: its last dimension over 16; NULL if that isn't whole."""
    last = F.element_at(shape, -1)
    return F.when(last % 16 == 0, (last / 16).cast("int"))


def lenient_int(x: Column) -> Column:
    """Integers with surrounding blanks; everything else is NULL."""
    return F.trim(x.cast("string")).try_cast("bigint")


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_commit(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike(r"^[0-9a-f]{40}\z"), F.lit(False))


def is_utc(x: Column) -> Column:
    """Shape of a timestamp only; no calendar check."""
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"), F.lit(False))


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def segment_name(layer: Column, k: Column) -> Column:
    return F.format_string("layer-%03d.k%d.safetensors", layer.cast("int"), k.cast("int"))


def index_name(k: Column) -> Column:
    return F.format_string("index-k%d.json", k.cast("int"))


def attestation_name(layer: Column, k: Column) -> Column:
    return F.format_string("attestations/layer-%03d.k%d.jsonl", layer.cast("int"), k.cast("int"))


def human(x: Column) -> Column:
    """Bytes in powers of 1024: whole bytes, else two digits, halves to even; TB is the last unit."""
    out = F.format_string("%d B", x.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(F.abs(x) >= 1024**power, F.format_string(f"%.2f {unit}", F.bround(x.cast("double") / 1024.0**power, 2))).otherwise(out)
    return out


def int_set(text: str) -> list[int]:
    """"3-10,12" as a sorted list; blanks are allowed."""
    out: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        if part:
            lo, _, hi = part.partition("-")
            out.update(range(int(lo), int(hi or lo) + 1))
    return sorted(out)


def int_set_column(text: Column) -> Column:
    """The same over a column."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.element_at(e, 1), F.element_at(e, -1))))))


def source_spec(text: str) -> dict:
    """REPO[@REVISION[:SUBDIR]]; refuses sub-paths that leave the repository."""
    repo, _, rest = text.partition("@")
    revision, _, subdir = rest.partition(":")
    parts = subdir.split("/") if subdir else []
    if not repo or subdir.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"bad source {text!r}")
    return {"repo": repo, "revision": revision.lower() if len(revision) == 40 else revision or "main", "subdir": subdir}


def family_spec(text: str) -> dict:
    """label=path[,k=3+4]."""
    label, eq, rest = text.partition("=")
    path, _, tiers = rest.partition(",k=")
    if not (label and eq and path):
        raise ValueError(f"bad family {text!r}")
    return {"label": label, "path": path, "k": [int(x) for x in tiers.split("+")] if tiers else []}


def locator(repo: str, revision: str, subdir: str = "") -> str:
    """An injective file name of a pinned source; refuses revisions that aren't full commits."""
    if not re.fullmatch("[0-9a-fA-F]{40}", revision):
        raise ValueError(f"{revision!r} is no commit")
    return f"{quote(repo, safe='')}@{revision.lower()}:{quote(subdir, safe='')}"


def locator_column(repo: Column, revision: Column, subdir: Column) -> Column:
    """The same over columns, NULL where the revision is no commit."""

    def quoted(x: Column) -> Column:  # url_encode writes a blank as +, keeps * and writes ~ as %7E
        return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    return F.when(is_commit(revision), F.concat(quoted(repo), F.lit("@"), F.lower(revision), F.lit(":"), quoted(F.coalesce(subdir, F.lit("")))))


def required_components(schema: Column, core: list[str], codebook: Column) -> Column:
    """Components named as {a|b|c} in a schema text, the core ones and the codebook's."""
    named = F.split(F.regexp_extract(schema, r"\{([^}]*)\}", 1), r"\|")
    every = F.array_union(F.array_union(F.filter(named, lambda x: x != ""), F.array(*map(F.lit, core))), F.array(codebook))
    odd = F.array_except(every, F.array(*map(F.lit, COMPONENTS)))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unsupported component "), F.array_join(odd, ",")))).otherwise(F.array_sort(every))
