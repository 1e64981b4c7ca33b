"""Registered queries of checks, evidence and documents, with their SQL twins; stand-ins as in ``catalog``.

Tensors are lineitem rows: layer l_suppkey % 10, expert l_partkey % 64, rank l_linenumber % 4, component by
l_returnflag, dtype by l_linestatus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmill.functions import digest as D
from fragmill.functions import names as N
from fragmill.operators import allocate as A
from fragmill.operators import assemble as S
from fragmill.operators import checks as C
from fragmill.operators import evidence as E
from fragmill.operators import layout as L
from fragmill.operators import plan as P
from fragmill.operators import release as R
from fragmill.operators import state as T
from fragmill.operators import trust as U
from fragmill.operators import verify as V
from fragmill.plans.catalog import BENEFIT, BUDGET, CELLS, EXPERTS, FRACTION, LAYERS, LIST, PLAN, SPANS, cells, gains, listing, plan, query, r6, snapshot, spans, table


def joined(column, sep=","):
    """An array as text, so that rows compare as plain values."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


# -- layout ----------------------------------------------------------------------------------------------------

GROUPED = f"{SPANS}, g AS (SELECT *, source_order * 1000 + lo // 40000 AS grp FROM sp WHERE doc_id % 7 <> 3), h AS (SELECT *, lo - lag(hi) OVER (PARTITION BY grp ORDER BY lo, hi) AS gap FROM g)"


@query("q51_expert_spans", f"WITH {GROUPED} SELECT CAST(grp AS BIGINT) AS grp, min(lo) AS lo, max(hi) AS hi, coalesce(max(abs(gap)), 0) = 0 AS contiguous FROM h GROUP BY grp")
def q51(spark, sf):
    s = spans(spark, sf).where("doc_id % 7 <> 3").withColumn("grp", (F.col("source_order") * 1000 + F.floor(F.col("lo") / 40000)).cast("long"))
    return L.expert_spans(s, ["grp"])


@query(
    "q52_coverage_holes",
    "WITH v AS (SELECT DISTINCT source, doc_id % 40 AS x FROM documents), g AS (SELECT source, min(x) AS lo, max(x) AS hi, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS present FROM v GROUP BY 1), a AS (SELECT source, unnest(range(lo, hi + 1)) AS x FROM g), m AS (SELECT a.source, string_agg(CAST(a.x AS VARCHAR), ',' ORDER BY a.x) AS holes FROM a LEFT JOIN v ON a.source = v.source AND a.x = v.x WHERE v.x IS NULL GROUP BY 1) SELECT g.source, lo, hi, present, coalesce(holes, '') AS holes FROM g LEFT JOIN m ON g.source = m.source",
)
def q52(spark, sf):
    c = L.coverage(table(spark, sf, "documents").select("source", (F.col("doc_id") % 40).alias("x")), ["source"], "x")
    return c.select("source", "lo", "hi", joined("present").alias("present"), joined("holes").alias("holes"))


@query("q53_count_by_tier", f"WITH {CELLS} SELECT layer, k, count(*) AS experts FROM e GROUP BY 1, 2")
def q53(spark, sf):
    return L.count_by_tier(cells(spark, sf))


@query("q54_max_layer_experts", f"WITH {CELLS}, n AS (SELECT layer, count(*) AS n FROM e GROUP BY 1) SELECT max(n) AS max_experts FROM n")
def q54(spark, sf):
    return L.max_layer_experts(L.count_by_tier(cells(spark, sf)))


STRICT = f"""{SPANS}, m AS (SELECT doc_id, source AS path, CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 5 WHEN 0 THEN 'I16' WHEN 1 THEN 'F32' WHEN 2 THEN 'U8' WHEN 3 THEN 'BF16' ELSE 'F9' END AS dtype, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE [1, CASE WHEN doc_id % 29 = 0 THEN -1 ELSE n_chars // CASE doc_id % 5 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 2 END END] END AS shape,
 CASE WHEN doc_id % 13 = 0 THEN lo - 3 ELSE lo END AS lo, CASE WHEN doc_id % 13 = 0 THEN hi - 3 ELSE hi END AS hi, max(hi) OVER (PARTITION BY source) - 5 AS body FROM sp),
 z AS (SELECT *, CASE dtype WHEN 'I16' THEN 2 WHEN 'F32' THEN 4 WHEN 'U8' THEN 1 WHEN 'BF16' THEN 2 END AS item, lag(hi) OVER (PARTITION BY path ORDER BY lo, hi, name) AS prev FROM m),
 y AS (SELECT doc_id, CASE WHEN item IS NULL THEN 'unknown dtype' WHEN shape IS NULL OR shape[2] < 0 THEN 'bad shape' WHEN NOT (lo >= 0 AND hi >= lo AND hi <= body) THEN 'span outside body' WHEN hi - lo <> item * shape[1] * shape[2] THEN 'span size' WHEN prev > lo THEN 'overlap' END AS rule FROM z)"""


@query("q55_span_violations", f"WITH {STRICT} SELECT doc_id, rule FROM y WHERE rule IS NOT NULL")
def q55(spark, sf):
    i = F.col("doc_id")
    kind = i % 5
    dtype = F.when(kind == 0, "I16").when(kind == 1, "F32").when(kind == 2, "U8").when(kind == 3, "BF16").otherwise("F9")
    s = spans(spark, sf)
    n = F.floor(F.col("size") / F.when(kind == 1, 4).when(kind == 2, 1).otherwise(2))
    shape = F.when(i % 23 != 0, F.array(F.lit(1).cast("long"), F.when(i % 29 == 0, F.lit(-1).cast("long")).otherwise(n)))
    moved = F.when(i % 13 == 0, 3).otherwise(0)
    body = s.groupBy("source").agg((F.max("hi") - 5).alias("body_size"))
    t = s.join(body, "source").select("doc_id", F.col("source").alias("path"), i.cast("string").alias("name"), dtype.alias("dtype"), shape.alias("shape"), (F.col("lo") - moved).alias("lo"), (F.col("hi") - moved).alias("hi"), "body_size")
    return L.span_violations(t).select("doc_id", "rule")


# -- plans -----------------------------------------------------------------------------------------------------


@query("q56_alias_match", "SELECT doc_id, (source || ':' || lang = a OR source = a OR lang = a) AS hit FROM (SELECT doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN source || ':' || lang ELSE 'none' END AS a FROM documents)")
def q56(spark, sf):
    d, kind = table(spark, sf, "documents"), F.col("doc_id") % 4
    both = F.concat_ws(":", "source", "lang")
    alias = F.when(kind == 0, F.col("source")).when(kind == 1, F.col("lang")).when(kind == 2, both).otherwise("none")
    return d.select("doc_id", P.matches_alias(alias, both, F.col("source"), F.col("lang")).alias("hit"))


@query("q57_bytes_needed", f"WITH {PLAN} SELECT source, source AS file, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM pl GROUP BY 1, 2")
def q57(spark, sf):
    return P.bytes_needed(plan(spark, sf))


FILES = f"{PLAN}, fl AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS size FROM sp GROUP BY 1), pn AS (SELECT source, CAST(sum(hi - lo) AS BIGINT) AS planned FROM pl GROUP BY 1), fp AS (SELECT fl.source, size, coalesce(planned, 0) AS planned, CASE CAST(substr(fl.source, 4) AS BIGINT) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'digest' ELSE 'refused' END AS method FROM fl LEFT JOIN pn ON fl.source = pn.source)"


@query("q58_authentication_cost", f"WITH {FILES} SELECT method, count(*) AS files, CAST(sum(CASE WHEN method = 'full' THEN size - planned ELSE 0 END) AS BIGINT) AS extra_bytes FROM fp GROUP BY 1")
def q58(spark, sf):
    files = spans(spark, sf).groupBy("source", "source_order").agg(F.sum("size").alias("size"))
    need = P.bytes_needed(plan(spark, sf)).select("source", F.col("bytes").alias("planned"))
    kind = F.col("source_order") % 3
    method = F.when(kind == 0, "full").when(kind == 1, "digest").otherwise("refused")
    return P.authentication_cost(files.join(need, "source", "left").fillna(0, ["planned"]).withColumn("method", method))


@query("q59_plan_digest", f"""WITH {PLAN} SELECT source, sha256('[' || string_agg('{{"local_off":' || local_off || ',"fragment":"' || fragment || '","source":"' || source || '","lo":' || lo || ',"hi":' || hi || ',"sha256":"' || fragment || '"}}', ',' ORDER BY local_off, fragment, source, lo) || ']') AS digest FROM pl GROUP BY 1""")
def q59(spark, sf):
    return P.plan_digest(plan(spark, sf), ["source"])


@query("q60_plan_drift", f"WITH {PLAN}, dr AS (SELECT fragment, source, lo, hi FROM pl), pv AS (SELECT fragment, source, CASE WHEN lo % 5 = 1 THEN lo + 1 ELSE lo END AS lo, hi FROM pl WHERE hi % 7 <> 2) SELECT *, 'draft' AS side FROM (SELECT * FROM dr EXCEPT ALL SELECT * FROM pv) UNION ALL SELECT *, 'proven' AS side FROM (SELECT * FROM pv EXCEPT ALL SELECT * FROM dr)")
def q60(spark, sf):
    draft = plan(spark, sf).select("fragment", "source", "lo", "hi")
    proven = draft.where("hi % 7 <> 2").withColumn("lo", F.when(F.col("lo") % 5 == 1, F.col("lo") + 1).otherwise(F.col("lo")))
    return P.plan_drift(draft, proven)


@query("q61_template_conflicts", "WITH h AS (SELECT doc_id % 12 AS layer, lang AS k, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CAST(doc_id % 12 AS VARCHAR) || CASE WHEN doc_id % 12 = 5 THEN source ELSE '' END END AS template FROM documents) SELECT layer, k, count(DISTINCT template) AS templates, count(*) FILTER (WHERE template IS NULL) AS missing FROM h GROUP BY 1, 2 HAVING count(DISTINCT template) <> 1 OR count(*) FILTER (WHERE template IS NULL) > 0")
def q61(spark, sf):
    layer = F.col("doc_id") % 12
    name = F.concat(layer.cast("string"), F.when(layer == 5, F.col("source")).otherwise(""))
    return P.template_conflicts(table(spark, sf, "documents").select(layer.alias("layer"), F.col("lang").alias("k"), F.when(F.col("doc_id") % 31 != 0, name).alias("template")))


# -- evidence --------------------------------------------------------------------------------------------------


@query("q62_index_or_state", "WITH i AS (SELECT doc_id, lang AS k FROM documents WHERE lang IN ('en', 'de') AND doc_id % 3 = 0), s AS (SELECT doc_id, lang AS k FROM documents WHERE doc_id % 3 = 1) SELECT * FROM i UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM i)")
def q62(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("k"))
    return E.index_or_state(d.where("k in ('en', 'de') and doc_id % 3 = 0"), d.where("doc_id % 3 = 1"))


@query("q63_weight_lookup", "SELECT l_orderkey, l_linenumber, p_brand AS shard FROM lineitem JOIN part ON l_partkey = p_partkey")
def q63(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("name"))
    return E.weight_lookup(t, table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("shard"))).drop("name")


OTHER = f"{SPANS}, b AS (SELECT source, lo // 2 + 100 AS lo, hi // 2 + 700 AS hi, doc_id AS b_id FROM sp WHERE doc_id % 9 = 1)"


@query("q64_interval_join", f"WITH {OTHER} SELECT sp.doc_id, b_id, sp.source, sp.lo AS a_lo, sp.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi FROM sp JOIN b ON sp.source = b.source AND sp.lo < b.hi AND b.lo < sp.hi WHERE sp.doc_id % 4 = 0")
def q64(spark, sf):
    s = spans(spark, sf)
    b = s.where("doc_id % 9 = 1").select("source", (F.floor(F.col("lo") / 2) + 100).alias("lo"), (F.floor(F.col("hi") / 2) + 700).alias("hi"), F.col("doc_id").alias("b_id"))
    return E.interval_join(s.where("doc_id % 4 = 0").select("doc_id", "source", "lo", "hi"), b, ["source"], 10_000).select("doc_id", "b_id", "source", "a_lo", "a_hi", "b_lo", "b_hi")


@query("q65_chunk_overlaps", f"WITH {SPANS}, c AS (SELECT doc_id, lo, hi, unnest(range(lo // 5000, (greatest(hi, lo + 1) - 1) // 5000 + 1)) AS chunk FROM sp) SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, greatest(lo, chunk * 5000) AS part_lo, least(hi, (chunk + 1) * 5000) AS part_hi FROM c")
def q65(spark, sf):
    return E.chunk_overlaps(spans(spark, sf).select("doc_id", "source", "lo", "hi"), 5000, ["source"]).select("doc_id", "chunk", "part_lo", "part_hi")


@query("q66_declared_digests", f"WITH {LIST}, dc AS (SELECT path, CASE WHEN doc_id % 10 = 4 THEN sha256(sha) ELSE sha END AS declared FROM a WHERE doc_id % 10 NOT IN (3, 5)) SELECT a.path, CASE WHEN declared IS NOT NULL AND declared <> sha THEN 'conflict' END AS rule FROM a LEFT JOIN dc ON a.path = dc.path")
def q66(spark, sf):
    a = listing(spark, sf)
    d = a.where("doc_id % 10 not in (3, 5)").select("path", F.when(F.col("doc_id") % 10 == 4, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return E.declared_digests(a, d).select("path", "rule")


METHOD = """m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'digest' WHEN 2 THEN 'full' ELSE 'unsafe' END AS requested, CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN sha256(source) END AS attested, sha256(text) AS got, CASE WHEN doc_id % 7 <> 0 THEN sha256(lang) END AS want, CASE WHEN doc_id % 5 <> 0 THEN sha256(lang) ELSE sha256(source) END AS whole FROM documents)"""


@query("q67_header_method", f"WITH {METHOD} SELECT doc_id, CASE WHEN requested = 'unsafe' THEN 'unsafe' WHEN requested IN ('digest', 'auto') AND coalesce(attested = got, false) THEN 'digest' WHEN requested = 'full' AND coalesce(want = whole, false) THEN 'full' WHEN requested = 'auto' AND attested IS NULL AND coalesce(want = whole, false) THEN 'full' ELSE 'refused' END AS method FROM m")
def q67(spark, sf):
    i = F.col("doc_id")
    sha = lambda c: F.sha2(c, 256)
    requested = F.when(i % 4 == 0, "auto").when(i % 4 == 1, "digest").when(i % 4 == 2, "full").otherwise("unsafe")
    attested = F.when(i % 3 == 0, sha("text")).when(i % 3 == 1, sha("source"))
    method = E.header_method(requested, attested, sha("text"), F.when(i % 7 != 0, sha("lang")), F.when(i % 5 != 0, sha("lang")).otherwise(sha("source")))
    return table(spark, sf, "documents").select("doc_id", method.alias("method"))


@query("q68_cache_fits", "SELECT CAST(doc_id AS VARCHAR) AS path, source, lang FROM documents WHERE doc_id % 10 < 7 AND doc_id % 10 NOT IN (2, 4, 5)")
def q68(spark, sf):
    d, i = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "source", "lang", "doc_id"), F.col("doc_id") % 10
    now = d.where("doc_id % 10 <> 5").withColumn("source", F.when(i == 2, "other").otherwise(F.col("source"))).withColumn("lang", F.when(i != 4, F.col("lang")))
    return E.cache_fits(d.where("doc_id % 10 < 7"), now, ["source", "lang"]).select("path", "source", "lang")


CARD = "c AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS layer, CAST(l_partkey % 64 AS BIGINT) AS expert, CASE WHEN l_suppkey % 10 = 1 THEN NULL WHEN l_suppkey % 10 = 2 AND l_linenumber = 1 THEN 65 WHEN l_suppkey % 10 = 3 THEN 60 ELSE 64 END AS signed, CASE WHEN l_suppkey % 10 = 4 THEN 63 WHEN l_suppkey % 10 = 3 THEN 60 ELSE 64 END AS header, CASE WHEN l_suppkey % 10 = 5 THEN 64 ELSE 10 END AS held, CASE WHEN l_suppkey % 10 = 6 THEN 12 END AS manifest, CASE WHEN l_suppkey % 10 = 7 THEN l_returnflag ELSE 'f' END AS family FROM lineitem)"


@query(
    "q69_authenticated_cardinality",
    f"WITH {CARD}, g AS (SELECT layer, max(expert) AS top, min(signed) AS lo, max(signed) AS hi, count(*) FILTER (WHERE signed IS NULL) AS un, bool_and(header = signed OR header = held) AS h, bool_and(manifest IS NULL OR manifest = signed) AS m, count(DISTINCT family) AS f FROM c GROUP BY 1), r AS (SELECT layer, CASE WHEN un > 0 THEN 'unsigned' WHEN lo <> hi THEN 'signed counts differ' WHEN NOT top < lo THEN 'expert out of bounds' WHEN NOT coalesce(h, false) THEN 'header' WHEN NOT coalesce(m, false) THEN 'manifest' WHEN f <> 1 THEN 'families' END AS rule FROM g) SELECT layer, rule FROM r WHERE rule IS NOT NULL",
)
def q69(spark, sf):
    layer, li = (F.col("l_suppkey") % 10).cast("long"), table(spark, sf, "lineitem")
    signed = F.when(layer == 2, F.when(F.col("l_linenumber") == 1, 65).otherwise(64)).when(layer == 3, 60).when(layer != 1, 64)
    rows = li.select(layer.alias("layer"), (F.col("l_partkey") % 64).cast("long").alias("expert"), signed.alias("signed"), F.when(layer == 4, 63).when(layer == 3, 60).otherwise(64).alias("header"), F.when(layer == 5, 64).otherwise(10).alias("held"), F.when(layer == 6, 12).alias("manifest"), F.when(layer == 7, F.col("l_returnflag")).otherwise("f").alias("family"))
    return E.authenticated_cardinality(rows)


@query("q70_completed_entries", "SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN 'no file' WHEN doc_id % 11 = 2 THEN 'header' WHEN doc_id % 11 = 3 THEN 'size' WHEN doc_id % 11 = 4 THEN 'experts' END AS rule FROM documents")
def q70(spark, sf):
    i = F.col("doc_id") % 11
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"), F.sha2("source", 256).alias("header_sha256"), F.col("n_chars").alias("size"))
    experts = lambda off: E.experts_digest(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), (F.col("doc_id") % 8).alias("expert"), F.sha2(F.concat("text", F.when(i == off, "x").otherwise("")), 256).alias("sha256")), ["file"])
    entries = d.join(experts(99), "file")
    files = d.where(i != 1).join(experts(4), "file").withColumn("header_sha256", F.when(i == 2, "other").otherwise(F.col("header_sha256"))).withColumn("size", F.when(i == 3, -1).otherwise(F.col("size")))
    return E.completed_entries(entries, files).select("doc_id", "rule")


# -- topology --------------------------------------------------------------------------------------------------

TENSORS = """t AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS layer, CAST(l_partkey % 64 AS BIGINT) AS expert, 'gate_proj' AS proj, l_linenumber % 4 AS rank, CASE l_returnflag WHEN 'A' THEN 'trellis' WHEN 'N' THEN 'suh' ELSE 'svh' END AS comp,
 CASE WHEN l_linestatus = 'F' THEN 'I16' ELSE 'F16' END AS dtype, CASE WHEN l_returnflag = 'A' THEN [1, 1, 16 * (l_linenumber % 3) + CAST(l_quantity AS INTEGER) // 50] ELSE [CAST(l_quantity AS INTEGER) % 2 * 16] END AS shape, l_linenumber AS k, l_orderkey FROM lineitem)"""


def tensors(spark, sf):
    li, flag = table(spark, sf, "lineitem"), F.col("l_returnflag")
    quantity = F.col("l_quantity").cast("int")
    shape = F.when(flag == "A", F.array(F.lit(1), F.lit(1), 16 * (F.col("l_linenumber") % 3) + F.floor(quantity / 50).cast("int"))).otherwise(F.array(quantity % 2 * 16))
    return li.select(
        (F.col("l_suppkey") % 10).cast("long").alias("layer"),
        (F.col("l_partkey") % 64).cast("long").alias("expert"),
        F.lit("gate_proj").alias("proj"),
        (F.col("l_linenumber") % 4).alias("rank"),
        F.when(flag == "A", "trellis").when(flag == "N", "suh").otherwise("svh").alias("comp"),
        F.when(F.col("l_linestatus") == "F", "I16").otherwise("F16").alias("dtype"),
        shape.alias("shape"),
        F.col("l_linenumber").alias("k"),
        "l_orderkey",
    )


@query(
    "q71_topology_violations",
    f"WITH {TENSORS}, g AS (SELECT layer, expert, comp, count(DISTINCT rank) AS d, min(rank) AS lo, max(rank) AS hi, count(*) AS n, bool_or(comp = 'trellis' AND NOT (dtype = 'I16' AND len(shape) = 3 AND shape[-1] % 16 = 0)) AS bad FROM t GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN NOT (d = 4 AND lo = 0 AND hi = 3) THEN 'ranks' WHEN n <> 4 THEN 'repeated rank' WHEN bad THEN 'packed shape' END AS rule FROM g) SELECT layer, expert, comp, n, rule FROM r WHERE rule IS NOT NULL",
)
def q71(spark, sf):
    return C.topology_violations(tensors(spark, sf)).select("layer", "expert", "comp", "n", "rule")


@query(
    "q72_scale_violations",
    f"WITH {TENSORS}, g AS (SELECT layer, expert, rank, max(CASE WHEN comp = 'trellis' THEN shape END) AS t, max(CASE WHEN comp = 'suh' THEN shape[1] END) AS suh, max(CASE WHEN comp = 'svh' THEN shape[1] END) AS svh FROM t GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN NOT coalesce(suh = 16 * t[1], false) THEN 'suh' WHEN NOT coalesce(svh = 16 * t[2], false) THEN 'svh' END AS rule FROM g) SELECT layer, expert, rank, suh, svh, rule FROM r WHERE rule IS NOT NULL",
)
def q72(spark, sf):
    return C.scale_violations(tensors(spark, sf)).select("layer", "expert", "rank", "suh", "svh", "rule")


SLOTS = f"{TENSORS}, o AS (SELECT layer, expert, proj, rank, comp, min(dtype || ':' || CAST(len(shape) AS VARCHAR)) AS dtype, min(shape) AS shape FROM t GROUP BY 1, 2, 3, 4, 5), x AS (SELECT * FROM o WHERE expert % 9 <> 1), y AS (SELECT layer, expert, proj, rank, comp, CASE WHEN expert % 9 = 2 THEN 'U8' ELSE dtype END AS dtype, CASE WHEN expert % 9 = 3 THEN list_prepend(7, shape) ELSE list_concat(shape[1:2], [9, 9]) END AS shape FROM o WHERE expert % 9 <> 4)"


@query("q73_topology_differences", f"WITH {SLOTS} SELECT coalesce(x.layer, y.layer) AS layer, coalesce(x.expert, y.expert) AS expert, coalesce(x.rank, y.rank) AS rank, coalesce(x.comp, y.comp) AS comp FROM x FULL JOIN y ON x.layer = y.layer AND x.expert = y.expert AND x.proj = y.proj AND x.rank = y.rank AND x.comp = y.comp WHERE NOT (coalesce(x.dtype = y.dtype, false) AND coalesce(x.shape[1:2] = y.shape[1:2], false))")
def q73(spark, sf):
    slot = ["layer", "expert", "proj", "rank", "comp"]
    o = tensors(spark, sf).groupBy(*slot).agg(F.min(F.concat("dtype", F.lit(":"), F.size("shape").cast("string"))).alias("dtype"), F.min("shape").alias("shape"))
    e = F.col("expert") % 9
    y = o.where(e != 4).withColumn("dtype", F.when(e == 2, "U8").otherwise(F.col("dtype"))).withColumn("shape", F.when(e == 3, F.concat(F.array(F.lit(7)), "shape")).otherwise(F.concat(F.slice("shape", 1, 2), F.array(F.lit(9), F.lit(9)))))
    return C.topology_differences(o.where(e != 1), y).select("layer", "expert", "rank", "comp")


@query(
    "q74_layer_analysis",
    f"WITH {TENSORS}, sl AS (SELECT layer, expert, proj, rank, string_agg(DISTINCT comp, ',' ORDER BY comp) AS comps FROM t GROUP BY 1, 2, 3, 4), ti AS (SELECT layer, expert, count(DISTINCT k) AS n FROM t GROUP BY 1, 2), a AS (SELECT layer, count(DISTINCT comps) AS signatures, max(len(string_split(comps, ','))) AS components FROM sl GROUP BY 1), b AS (SELECT layer, max(n) AS tiers FROM ti GROUP BY 1), c AS (SELECT layer, count(*) AS rows FROM t WHERE layer < 4 AND k = 7 GROUP BY 1) SELECT a.layer, signatures, CAST(components AS BIGINT) AS components, tiers, coalesce(rows, 0) AS shared_rows, CASE WHEN coalesce(rows, 0) > 0 THEN 'shared_h_v1' ELSE 'per_expert_v1' END AS layout FROM a JOIN b ON a.layer = b.layer LEFT JOIN c ON a.layer = c.layer",
)
def q74(spark, sf):
    t = tensors(spark, sf)
    return C.layer_analysis(t, t.where("layer < 4 and k = 7")).withColumn("components", F.col("components").cast("long"))


BITMAP = "h AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS layer, CAST(l_partkey % 64 AS BIGINT) AS expert, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2), w AS (SELECT layer, expert, CASE WHEN layer = 2 AND expert % 16 = 3 THEN k + 1 ELSE k END AS k FROM h WHERE layer <> 5 AND NOT (layer = 4 AND expert = 63))"


@query(
    "q75_bitmap_agreement",
    f"WITH {BITMAP}, a AS (SELECT layer, list(k ORDER BY expert) AS have FROM h GROUP BY 1), b AS (SELECT layer, list(k ORDER BY expert) AS want FROM w GROUP BY 1), z AS (SELECT a.layer, have, want, len(list_filter(list_zip(have, want), lambda x: x[1] IS DISTINCT FROM x[2])) AS bad FROM a LEFT JOIN b ON a.layer = b.layer) SELECT layer, CASE WHEN want IS NULL THEN 'no-tier-bitmap' WHEN len(have) <> len(want) THEN 'MISMATCH(len ' || len(have) || '/' || len(want) || ')' WHEN bad > 0 THEN 'MISMATCH(' || bad || ' experts)' ELSE 'agrees' END AS agreement FROM z",
)
def q75(spark, sf):
    h = cells(spark, sf).groupBy("layer", "expert").agg(F.min("k").alias("k"))
    w = h.where("layer <> 5 and not (layer = 4 and expert = 63)").withColumn("k", F.when((F.col("layer") == 2) & (F.col("expert") % 16 == 3), F.col("k") + 1).otherwise(F.col("k")))
    return C.bitmap_agreement(h, S.tier_map(w).select("layer", F.col("bits").alias("k")))


@query("q76_effective_layout", "SELECT lang, CASE WHEN lang = 'en' THEN 'rank_sliced' WHEN lang = 'de' THEN 'per_expert_v1' ELSE 'dense' END AS layout FROM (SELECT DISTINCT lang FROM documents)")
def q76(spark, sf):
    d = table(spark, sf, "documents")
    seen = {"en": F.when(F.col("doc_id") % 2 == 0, "rank_sliced").otherwise("per_expert_v1"), "de": F.when(F.col("doc_id") % 3 == 0, F.lit("shared_h_v1")).otherwise("per_expert_v1")}
    out = None
    for r in d.select("lang").distinct().collect():
        rows = d.where(F.col("lang") == r.lang).select(seen.get(r.lang, F.lit(None).cast("string")).alias("layout"), F.lit(False).alias("routed"))
        one = C.effective_layout(rows).select(F.lit(r.lang).alias("lang"), "layout")
        out = one if out is None else out.union(one)
    return out


# -- statements ------------------------------------------------------------------------------------------------

PAYLOAD = """p AS (SELECT doc_id, CASE doc_id % 17 WHEN 1 THEN 'copy-of' ELSE 'repack-of' END AS predicate, doc_id % 90 AS layer, doc_id % 5 AS k, CASE doc_id % 17 WHEN 2 THEN 'x' ELSE '' END AS odd, CASE doc_id % 17 WHEN 3 THEN upper(sha256(text)) WHEN 4 THEN sha256(text) || chr(10) WHEN 5 THEN NULL ELSE sha256(text) END AS sha256, CASE doc_id % 17 WHEN 6 THEN 0 ELSE n_chars END AS size, CASE doc_id % 17 WHEN 7 THEN NULL ELSE 8 END AS num_experts, CASE doc_id % 17 WHEN 8 THEN 'no digest' ELSE sha256(lang) END AS ed, CASE doc_id % 17 WHEN 9 THEN '01' WHEN 10 THEN '7' || chr(10) ELSE '7' END AS eid, CASE doc_id % 17 WHEN 11 THEN '2026-01-01T00:00:00' WHEN 12 THEN '2026-01-01T00:00:00Z' || chr(10) ELSE '2026-01-01T00:00:00Z' END AS created, doc_id % 17 = 13 AS bare FROM documents)"""


@query(
    "q77_identity_violations",
    f"WITH {PAYLOAD}, r AS (SELECT doc_id, CASE WHEN predicate <> 'repack-of' THEN 'predicate' WHEN odd <> '' THEN 'file name' WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{{64}}'), false) THEN 'digest' WHEN NOT size > 0 THEN 'size' WHEN num_experts IS NULL THEN 'experts' WHEN NOT regexp_full_match(ed, '[0-9a-f]{{64}}') THEN 'expert digest' WHEN NOT regexp_full_match(eid, '0|[1-9][0-9]*') THEN 'expert id' WHEN NOT regexp_full_match(created, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') THEN 'time' WHEN bare THEN 'materials' END AS rule FROM p) SELECT doc_id, rule FROM r WHERE rule IS NOT NULL",
)
def q77(spark, sf):
    i, sha = F.col("doc_id") % 17, F.sha2("text", 256)
    nl = lambda c: F.concat(c, F.lit("\n"))
    layer, k = F.col("doc_id") % 90, F.col("doc_id") % 5
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(i == 1, "copy-of").otherwise("repack-of").alias("predicate"),
        layer.alias("layer"),
        k.alias("k"),
        F.concat(F.format_string("layer-%03d.k%d.safetensors", layer, k), F.when(i == 2, "x").otherwise("")).alias("file"),
        F.when(i == 3, F.upper(sha)).when(i == 4, nl(sha)).when(i != 5, sha).alias("sha256"),
        F.when(i == 6, 0).otherwise(F.col("n_chars")).alias("size"),
        F.when(i != 7, 8).alias("num_experts"),
        F.create_map(F.when(i == 9, "01").when(i == 10, "7\n").otherwise("7"), F.when(i == 8, "no digest").otherwise(F.sha2("lang", 256))).alias("expert_sha256"),
        F.when(i == 11, "2026-01-01T00:00:00").when(i == 12, "2026-01-01T00:00:00Z\n").otherwise("2026-01-01T00:00:00Z").alias("created_utc"),
        F.when(i == 13, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("repo"), F.col("source"))).alias("materials"),
    )
    return C.identity_violations(rows).select("doc_id", "rule")


BINDING = "b AS (SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'nobody' ELSE source END AS provider, CASE doc_id % 8 WHEN 2 THEN sha256(lang) ELSE sha256(source) END AS manifest, CASE doc_id % 8 WHEN 3 THEN sha256(text) || chr(10) WHEN 4 THEN NULL ELSE sha256(text) END AS sha FROM documents), pv AS (SELECT DISTINCT source AS provider, CASE CAST(substr(source, 4) AS BIGINT) % 4 WHEN 1 THEN NULL WHEN 2 THEN 'main' WHEN 3 THEN upper(sha1(source)) ELSE sha1(source) END AS revision, sha256(source) AS have FROM documents)"


@query(
    "q78_binding_violations",
    f"WITH {BINDING}, r AS (SELECT doc_id, b.provider, CASE WHEN revision IS NULL THEN 'no provider' WHEN NOT regexp_full_match(lower(revision), '[0-9a-f]{{40}}') THEN 'not pinned' WHEN have <> manifest THEN 'manifest' WHEN NOT coalesce(regexp_full_match(sha, '[0-9a-f]{{64}}'), false) THEN 'digest' END AS rule FROM b LEFT JOIN pv ON b.provider = pv.provider) SELECT * FROM r WHERE rule IS NOT NULL",
)
def q78(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id") % 8
    kind = F.substring("source", 4, 9).cast("long") % 4
    providers = d.select("source").distinct().select(F.col("source").alias("provider"), F.when(kind == 2, "main").when(kind == 3, F.upper(F.sha1("source"))).when(kind == 0, F.sha1("source")).alias("revision"), F.sha2("source", 256).alias("manifest_sha256"))
    binding = d.select("doc_id", F.when(i == 1, "nobody").otherwise(F.col("source")).alias("provider"), F.when(i == 2, F.sha2("lang", 256)).otherwise(F.sha2("source", 256)).alias("manifest_sha256"), F.when(i == 3, F.concat(F.sha2("text", 256), F.lit("\n"))).when(i != 4, F.sha2("text", 256)).alias("sha256"))
    return C.binding_violations(binding, providers).select("doc_id", "provider", "rule")


@query("q79_fragment_binding", "SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'source' WHEN 2 THEN 'lang' WHEN 3 THEN 'n_chars' END AS mismatch, doc_id % 6 IN (0, 4, 5) AS binding_ok FROM documents")
def q79(spark, sf):
    i, d = F.col("doc_id") % 6, table(spark, sf, "documents")
    rows = d.withColumns({"want_source": F.when(i == 1, "x").otherwise(F.col("source")), "want_lang": F.when((i != 2) & (i != 1), F.col("lang")), "want_n_chars": F.when(i == 3, -1).otherwise(F.col("n_chars"))})
    return C.fragment_binding(rows, ["source", "lang", "n_chars"]).select("doc_id", "mismatch", "binding_ok")


SEGMENTS = "s AS (SELECT doc_id AS layer, doc_id % 3 AS k, CASE WHEN doc_id % 14 = 1 THEN 'b' ELSE 'a' END AS base_model, CASE WHEN doc_id % 14 = 2 THEN NULL ELSE 'l' END AS layout FROM documents)"


@query("q80_pinned_violations", f"WITH {SEGMENTS}, f AS (SELECT base_model AS b, layout AS l FROM s ORDER BY layer, k LIMIT 1) SELECT layer, k, CASE WHEN NOT coalesce(base_model = b, false) THEN 'base_model' ELSE 'layout' END AS rule FROM s, f WHERE NOT (coalesce(base_model = b, false) AND coalesce(layout = l, false))")
def q80(spark, sf):
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(i.alias("layer"), (i % 3).alias("k"), F.when(i % 14 == 1, "b").otherwise("a").alias("base_model"), F.when(i % 14 != 2, "l").alias("layout"))
    return C.pinned_violations(rows, ["base_model", "layout"]).select("layer", "k", "rule")


@query("q81_verdict_summary", f"WITH {LIST} SELECT count(*) AS checked, count(*) FILTER (WHERE coalesce(a.sha = b.sha, false)) AS matched, count(*) FILTER (WHERE NOT coalesce(a.sha = b.sha, false)) AS failures, CAST(coalesce(sum(a.size) FILTER (WHERE a.sha = b.sha), 0) AS BIGINT) AS bytes FROM a LEFT JOIN b ON a.doc_id = b.doc_id")
def q81(spark, sf):
    rows = listing(spark, sf).select("doc_id", "size", F.col("sha256").alias("want")).join(snapshot(spark, sf).select("doc_id", F.col("sha256").alias("got")), "doc_id", "left")
    return C.verdict_summary(C.digest_verdicts(rows))


KEYS = "ky AS (SELECT CASE n_nationkey % 9 WHEN 1 THEN sha256(CAST(n_nationkey AS VARCHAR)) || chr(10) WHEN 2 THEN sha256('two') ELSE sha256(CAST(n_nationkey AS VARCHAR)) END AS fingerprint, CASE WHEN n_nationkey % 9 = 3 THEN 'same' ELSE n_name END AS key_id, CASE WHEN n_nationkey % 9 = 4 THEN 'lost' ELSE 'active' END AS status, CASE WHEN n_nationkey % 9 = 5 THEN '1.2.2026' WHEN n_nationkey % 9 = 6 THEN '2026-01-01' || chr(10) ELSE '2026-01-01' END AS added FROM nation), kf AS (SELECT DISTINCT fingerprint FROM ky WHERE key_id NOT LIKE 'A%' UNION SELECT sha256('unlisted'))"


@query(
    "q82_trust_root_violations",
    f"WITH {KEYS}, sh AS (SELECT fingerprint, key_id, CASE WHEN NOT regexp_full_match(fingerprint, '[0-9a-f]{{64}}') THEN 'fingerprint' WHEN status NOT IN ('active', 'retired', 'revoked') THEN 'status' WHEN NOT regexp_full_match(added, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'added' END AS rule FROM ky) SELECT * FROM sh WHERE rule IS NOT NULL UNION ALL SELECT fingerprint, NULL, 'repeated fingerprint' FROM ky GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT NULL, key_id, 'repeated id' FROM ky GROUP BY key_id HAVING count(*) > 1 UNION ALL SELECT coalesce(ky.fingerprint, kf.fingerprint), key_id, CASE WHEN kf.fingerprint IS NULL THEN 'no key file' ELSE 'unlisted key file' END FROM ky FULL JOIN kf ON ky.fingerprint = kf.fingerprint WHERE key_id IS NULL OR kf.fingerprint IS NULL",
)
def q82(spark, sf):
    n, i = table(spark, sf, "nation"), F.col("n_nationkey") % 9
    fp = F.sha2(F.col("n_nationkey").cast("string"), 256)
    nl = lambda c: F.concat(c, F.lit("\n"))
    keys = n.select(F.when(i == 1, nl(fp)).when(i == 2, F.sha2(F.lit("two"), 256)).otherwise(fp).alias("fingerprint"), F.when(i == 3, "same").otherwise(F.col("n_name")).alias("key_id"), F.when(i == 4, "lost").otherwise("active").alias("status"), F.when(i == 5, "1.2.2026").when(i == 6, "2026-01-01\n").otherwise("2026-01-01").alias("added"))
    files = keys.where("key_id not like 'A%'").select("fingerprint").union(n.select(F.sha2(F.lit("unlisted"), 256)).limit(1)).distinct()
    return C.trust_root_violations(keys, files)


@query("q83_manifest_cardinality", "WITH x AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS layer, count(DISTINCT l_partkey % 64) AS n FROM lineitem GROUP BY 1) SELECT layer, 'manifest' AS rule FROM x WHERE layer < 6 AND layer % 3 = 1")
def q83(spark, sf):
    c = cells(spark, sf).select("layer", "expert").distinct()
    declared = c.groupBy("layer").agg(F.countDistinct("expert").alias("n")).where("layer < 6").select("layer", (F.col("n") + F.when(F.col("layer") % 3 == 1, 1).otherwise(0)).alias("experts"))
    return C.cardinality_violations(c, c, declared)


# -- state -----------------------------------------------------------------------------------------------------


@query("q84_state_migration", "SELECT 'fp' AS source_fp, CAST(doc_id % 5 AS INTEGER) AS k, CAST(doc_id % 300 AS INTEGER) AS layer, doc_id FROM documents WHERE doc_id % 4 <> 1")
def q84(spark, sf):
    i = F.col("doc_id")
    name = F.concat(F.format_string("layer-%03d.k%d.safetensors", i % 300, i % 5), F.when(i % 4 == 1, ".part").otherwise(""))
    return T.migrate(table(spark, sf, "documents").select(name.alias("file"), "doc_id"), "fp").drop("file")


@query("q85_resumable", "SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'no entry' WHEN 2 THEN 'other source' WHEN 3 THEN 'other layout' WHEN 4 THEN 'no file' WHEN 5 THEN 'size' WHEN 6 THEN 'digest' WHEN 7 THEN 'not signed' END AS reason FROM documents")
def q85(spark, sf):
    i, sha = F.col("doc_id") % 9, F.sha2("text", 256)
    size = F.col("n_chars")
    row = {"entry_sha": F.when(i != 1, sha), "entry_size": size, "file_sha": F.when(i == 6, F.sha2("lang", 256)).otherwise(sha), "file_size": F.when(i == 5, size + 1).when(i != 4, size), "source": F.col("source"), "want_source": F.when(i != 2, F.col("source")), "layout": F.lit("a"), "want_layout": F.when(i == 3, "b").otherwise("a"), "signed": F.when(i != 7, F.lit(True))}
    return table(spark, sf, "documents").select("doc_id", T.resumable(row).alias("reason"))


@query("q86_family_violations", "SELECT doc_id FROM documents WHERE NOT (source = 'src1' AND lang = 'en')")
def q86(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("base_model"), F.col("lang").alias("layout"))
    return T.family_violations(d, "src1", "en").select("doc_id")


@query("q87_digest_cache", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 IN (0, 1) THEN sha256(text) END AS sha256 FROM documents")
def q87(spark, sf):
    i = F.col("doc_id") % 5
    files = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.length("source").alias("mtime"), F.sha2("text", 256).alias("sha256"))
    cache = files.where("doc_id % 5 <> 4").withColumn("size", F.when(i == 2, -1).otherwise(F.col("size"))).withColumn("mtime", F.when(i == 3, F.lit(0)).otherwise(F.col("mtime")))
    return T.digest_cache(files.drop("sha256"), cache).select("path", "sha256")


@query("q88_index_for", f"WITH {SPANS}, r AS (SELECT source_order AS layer, doc_id AS expert, lo, hi, sha256(source) AS sha FROM sp WHERE k = 'en') SELECT CAST(layer AS BIGINT) AS layer, string_agg(expert || ':' || lo || '-' || hi, ',' ORDER BY expert) AS experts, min(sha) AS sha256 FROM r GROUP BY 1")
def q88(spark, sf):
    s = spans(spark, sf)
    rows = s.select(F.col("source_order").alias("layer"), F.when(F.col("k") == "en", 3).otherwise(4).alias("k"), F.col("doc_id").alias("expert"), "lo", "hi", F.sha2("source", 256).alias("sha256"))
    text = F.transform(F.map_entries("experts"), lambda e: F.concat(e.key.cast("string"), F.lit(":"), F.array_join(F.transform(e.value, lambda x: x.cast("string")), "-")))
    return T.index_for(rows, 3).select("layer", F.array_join(text, ",").alias("experts"), "sha256")


@query("q89_merge_manifest", "SELECT lang AS k, count(*) AS segments FROM documents WHERE lang IN ('en', 'de') GROUP BY 1 UNION ALL SELECT lang, count(*) + 1000 FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY 1")
def q89(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("segments"))
    return T.merge_manifest(d.withColumn("segments", F.col("segments") + 1000), d.where("k in ('en', 'de')"))


# -- releases --------------------------------------------------------------------------------------------------


@query("q90_cross_check", f"WITH {LIST}, f AS (SELECT a.path, CASE WHEN b.path IS NULL THEN 'uncovered' WHEN coalesce(a.sha = b.sha AND a.size = b.size, false) THEN 'covered' ELSE 'conflict' END AS state FROM a LEFT JOIN b ON a.path = b.path) SELECT path, state, state <> 'covered' AS fails FROM f")
def q90(spark, sf):
    return R.cross_check(listing(spark, sf), snapshot(spark, sf), strict=True).select("path", "state", "fails")


@query("q91_expert_covered", "WITH f AS (SELECT doc_id % 200 AS fragment, CASE WHEN doc_id % 2 = 0 THEN 'segment' ELSE 'attestation' END AS role, CASE WHEN doc_id % 3 = 0 THEN 'uncovered' ELSE 'covered' END AS state FROM (SELECT doc_id * 7 // 3 AS doc_id FROM documents)) SELECT fragment, bool_or(role = 'segment' AND state = 'covered') AND bool_or(role = 'attestation' AND state = 'covered') AS covered FROM f GROUP BY 1")
def q91(spark, sf):
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") * 7 / 3).alias("doc_id"))
    return R.expert_covered(d.select((F.col("doc_id") % 200).alias("fragment"), F.when(F.col("doc_id") % 2 == 0, "segment").otherwise("attestation").alias("role"), F.when(F.col("doc_id") % 3 == 0, "uncovered").otherwise("covered").alias("state")))


VERIFIED = "v AS (SELECT lang AS family, source AS file, doc_id AS line_no, doc_id % 4 = 2 AS ok, CASE doc_id % 4 WHEN 2 THEN 'verified' WHEN 3 THEN CASE WHEN source = 'src3' THEN 'bad signature' ELSE 'untrusted key' END ELSE 'untrusted key' END AS reason FROM documents)"


def verified(spark, sf):
    i = F.col("doc_id") % 4
    reason = F.when(i == 2, "verified").when((i == 3) & (F.col("source") == "src3"), "bad signature").otherwise("untrusted key")
    body = F.to_json(F.struct(F.create_map(F.lit("0"), F.sha2("text", 256), (F.col("doc_id") % 5 + 1).cast("string"), F.sha2("lang", 256)).alias("expert_sha256"), (F.col("doc_id") % 7).alias("layer"), F.lit(3).alias("k")))
    return table(spark, sf, "documents").select(F.col("lang").alias("family"), F.col("source").alias("file"), F.col("doc_id").alias("line_no"), (i == 2).alias("ok"), reason.alias("reason"), F.when(i == 2, body).alias("payload"))


@query("q92_first_pinned", f"WITH {VERIFIED}, r AS (SELECT *, bool_or(reason = 'bad signature') OVER (PARTITION BY family, file) AS rej, row_number() OVER (PARTITION BY family, file ORDER BY ok DESC, line_no) AS n FROM v) SELECT family, file, line_no FROM r WHERE n = 1 AND ok AND NOT rej")
def q92(spark, sf):
    return U.first_pinned(verified(spark, sf)).select("family", "file", "line_no")


@query(
    "q93_attested_digests",
    "WITH l AS (SELECT lang AS family, source AS file, doc_id AS line_no, doc_id % 7 AS layer, sha256(text) AS a, sha256(lang) AS b, doc_id % 5 + 1 AS e FROM documents WHERE doc_id % 4 = 2), x AS (SELECT family, file, line_no, layer, 0 AS expert, a AS sha256 FROM l UNION ALL SELECT family, file, line_no, layer, e, b FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY family, file, expert ORDER BY line_no) AS n FROM x) SELECT family, file, layer, 3 AS k, expert, sha256 FROM r WHERE n = 1",
)
def q93(spark, sf):
    return U.attested_digests(verified(spark, sf))


@query("q94_verdicts_by_reason", f"WITH {VERIFIED} SELECT reason, count(*) AS lines FROM v GROUP BY 1")
def q94(spark, sf):
    return U.summary(verified(spark, sf))


# -- proofs ----------------------------------------------------------------------------------------------------

PROOF = "i AS (SELECT doc_id % 40 AS layer, doc_id % 3 AS k, doc_id AS expert, sha256(text) AS sha, doc_id % 12 AS m FROM documents)"


def proof(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select((i % 40).alias("layer"), (i % 3).alias("k"), i.alias("expert"), F.sha2("text", 256).alias("sha256"), (i % 12).alias("m"))


@query("q95_identity_local", f"WITH {PROOF} SELECT expert, CASE WHEN m IN (1, 2) THEN 'missing' WHEN m = 3 THEN 'mismatch' ELSE 'ok' END AS verdict FROM i")
def q95(spark, sf):
    p = proof(spark, sf)
    got = p.where("m <> 2").withColumn("sha256", F.when(F.col("m") == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return V.identity_local(p.drop("sha256"), p.where("m <> 1"), got).select("expert", "verdict")


@query("q96_identity_remote", f"WITH {PROOF} SELECT CAST(expert AS VARCHAR) AS name, CASE WHEN m IN (1, 2) THEN 'missing' WHEN m = 3 THEN 'mismatch' ELSE 'ok' END AS verdict FROM i")
def q96(spark, sf):
    p = proof(spark, sf).select(F.col("expert").cast("string").alias("name"), "sha256", "m")
    fresh = p.where("m <> 2").withColumn("sha256", F.when(F.col("m") == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return V.identity_remote(p.where("m <> 1"), fresh).select("name", "verdict")


@query("q97_identity_derived", f"WITH {PROOF}, x AS (SELECT layer, expert, CASE WHEN m < 6 THEN sha ELSE sha256(CAST(layer AS VARCHAR)) END AS got, m, sha FROM i) SELECT layer, expert, CASE WHEN m < 6 AND m <> 1 THEN CASE WHEN m = 2 THEN 'mismatch' ELSE 'ok' END WHEN layer = 7 THEN 'missing' WHEN m = 1 THEN 'mismatch' ELSE 'ok' END AS verdict FROM x")
def q97(spark, sf):
    slot = {"proj": F.lit("up_proj"), "rank": F.lit(0), "comp": F.lit("suh")}
    common = F.sha2(F.col("layer").cast("string"), 256)
    p = proof(spark, sf).withColumns(slot)
    expanded = p.withColumn("sha256", F.when(F.col("m") < 6, F.col("sha256")).otherwise(common))
    parent = p.where("m < 6 and m <> 1").withColumn("sha256", F.when(F.col("m") == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    profile = p.where("layer <> 7").select("layer", *slot).distinct().withColumn("sha256", common)
    return V.identity_derived(expanded, parent, profile).select("layer", "expert", "verdict")


@query("q98_identity_fetched", f"WITH {PROOF} SELECT expert, CASE WHEN m = 1 THEN 'uncovered' WHEN m = 4 THEN 'uncovered' WHEN m = 3 THEN 'mismatch' WHEN m = 2 THEN 'missing' ELSE 'ok' END AS verdict FROM i")
def q98(spark, sf):
    p = proof(spark, sf)
    one = p.where("m <> 1").withColumn("sha256", F.when(F.col("m") == 3, F.sha2("sha256", 256)).when(F.col("m") != 2, F.col("sha256")))
    return V.identity_fetched(p, one.union(p.where("m = 4"))).select("expert", "verdict")


@query("q99_seeded_sample", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) SELECT doc_id, source FROM r WHERE n <= 5")
def q99(spark, sf):
    return V.sample(table(spark, sf, "documents").select("doc_id", "source"), "source", 5, 7, "doc_id")


@query("q100_report", f"WITH {PROOF} SELECT 'identity.local' AS \"check\", CASE WHEN m IN (1, 2) THEN 'missing' WHEN m = 3 THEN 'mismatch' ELSE 'ok' END AS verdict, count(*) AS rows FROM i GROUP BY 1, 2")
def q100(spark, sf):
    p = proof(spark, sf)
    got = p.where("m <> 2").withColumn("sha256", F.when(F.col("m") == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return V.report(V.identity_local(p.drop("sha256"), p.where("m <> 1"), got))


# -- assembly --------------------------------------------------------------------------------------------------


@query("q101_with_shared", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id WHEN source = 'src2' THEN NULL ELSE CAST(substr(source, 4) AS BIGINT) END AS value FROM documents")
def q101(spark, sf):
    slot = {"proj": F.lit("up_proj"), "rank": F.lit(0), "comp": F.lit("suh")}
    t = table(spark, sf, "documents").select("doc_id", F.substring("source", 4, 9).cast("long").alias("layer"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("value")).withColumns(slot)
    shared = t.where("layer <> 2").select("layer", *slot).distinct().withColumn("value", F.col("layer"))
    return S.with_shared(t, shared).select("doc_id", "value")


@query("q102_shard_index", "SELECT sha256(text) AS name, max(source) AS shard FROM documents GROUP BY 1")
def q102(spark, sf):
    return S.shard_index(table(spark, sf, "documents").select(F.sha2("text", 256).alias("name"), F.col("source").alias("shard")))


@query("q103_needs_reindex", f"WITH {SPANS}, o AS (SELECT source, n_chars AS old, CASE WHEN doc_id % 400 = 1 THEN n_chars * 2 WHEN doc_id % 300 = 2 THEN NULL ELSE n_chars END AS new FROM sp) SELECT source AS shard, bool_or(new <> old) AS reindex, count(*) FILTER (WHERE new IS NULL) AS missing FROM o GROUP BY 1")
def q103(spark, sf):
    s = spans(spark, sf).withColumn("layer", F.col("source_order")).withColumn("expert", F.col("doc_id"))
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name")
    src = s.select(F.col("source").alias("shard"), "layer", "expert", name, "lo", "hi")
    pol = s.where("doc_id % 400 = 1 or doc_id % 300 = 2").select("layer", "expert", F.lit(4).alias("k"))
    seg = s.where("doc_id % 400 = 1").select("layer", "expert", F.lit(4).alias("k"), name, (F.col("size") * 2).alias("size"), F.lit("I16").alias("dtype"))
    return S.needs_reindex(S.override_join(src, pol, seg))


@query("q104_total_size", f"WITH {SPANS} SELECT CAST(sum(hi - lo) AS BIGINT) AS total_size FROM sp")
def q104(spark, sf):
    return S.total_size(spans(spark, sf))


@query("q105_config_bits", f"WITH {CELLS}, m AS (SELECT layer, expert, min(k) AS k FROM e GROUP BY 1, 2), g AS (SELECT list(DISTINCT k ORDER BY k) AS ks FROM m) SELECT len(ks) > 1 AS mixed, CASE WHEN len(ks) > 1 THEN 'mixed' ELSE CAST(ks[1] AS VARCHAR) || '.0' END AS bits, CASE WHEN len(ks) > 1 THEN array_to_string(ks, ',') END AS k_values FROM g")
def q105(spark, sf):
    return S.config_bits(cells(spark, sf).groupBy("layer", "expert").agg(F.min("k").alias("k"))).withColumn("k_values", joined("k_values"))


@query("q106_tree_manifest", "SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END) || '  ' || source || '/' || doc_id AS line FROM documents WHERE doc_id % 5 <> 0")
def q106(spark, sf):
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 5 == 0, "MANIFEST.sha256").otherwise(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    files = d.select(path.alias("path"), F.col("text").alias("content"))
    known = d.where("doc_id % 3 = 0 and doc_id % 5 <> 0").select(path.alias("path"), F.sha2("lang", 256).alias("sha256"))
    return S.tree_manifest(files, known)


# -- scalars ---------------------------------------------------------------------------------------------------

TENSOR_NAMES = "n AS (SELECT l_orderkey, l_linenumber, 'model.layers.' || l_suppkey % 10 || '.mlp.experts.' || l_partkey % 64 || '.' || CASE l_linenumber % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'up' ELSE 'down' END || '_proj.rank' || l_linenumber % 4 || '.' || CASE l_returnflag WHEN 'A' THEN 'trellis' WHEN 'N' THEN 'suh' ELSE 'svh' END || CASE WHEN l_orderkey % 50 = 7 THEN chr(10) ELSE '' END AS name FROM lineitem)"


@query(
    "q107_tensor_key",
    f"WITH {TENSOR_NAMES}, x AS (SELECT DISTINCT name, CAST(regexp_extract(name, 'layers\\.([0-9]+)', 1) AS INTEGER) AS layer, CAST(regexp_extract(name, 'experts\\.([0-9]+)', 1) AS INTEGER) AS expert, CASE regexp_extract(name, '([a-z]+)_proj', 1) WHEN 'gate' THEN 0 WHEN 'up' THEN 1 ELSE 2 END AS p, CAST(regexp_extract(name, 'rank([0-9]+)', 1) AS INTEGER) AS rank, CASE regexp_extract(name, '([a-z]+)$', 1) WHEN 'trellis' THEN 0 WHEN 'suh' THEN 1 ELSE 2 END AS c FROM n WHERE name NOT LIKE '%' || chr(10)) SELECT name, layer, expert, p AS proj_ord, rank, c AS comp_ord, CAST(row_number() OVER (PARTITION BY layer ORDER BY expert, p, rank, c, name) AS BIGINT) AS place FROM x",
)
def q107(spark, sf):
    from pyspark.sql import Window as W

    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    proj = F.when(line % 3 == 0, "gate").when(line % 3 == 1, "up").otherwise("down")
    comp = F.when(flag == "A", "trellis").when(flag == "N", "suh").otherwise("svh")
    name = F.format_string("model.layers.%d.mlp.experts.%d.%s_proj.rank%d.%s%s", F.col("l_suppkey") % 10, F.col("l_partkey") % 64, proj, line % 4, comp, F.when(F.col("l_orderkey") % 50 == 7, "\n").otherwise(""))
    keyed = N.with_tensor_key(table(spark, sf, "lineitem").select(name.alias("name")).distinct())
    place = F.row_number().over(W.partitionBy("layer").orderBy(*N.CANONICAL)).cast("long")
    return keyed.select("name", "layer", "expert", "proj_ord", "rank", "comp_ord", place.alias("place"))


@query(
    "q108_shapes_of_scalars",
    "WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN sha256(text) || chr(10) WHEN 3 THEN substr(sha256(text), 1, 63) END AS d, CASE doc_id % 5 WHEN 0 THEN substr(sha256(text), 1, 40) WHEN 1 THEN upper(substr(sha256(text), 1, 40)) WHEN 2 THEN substr(sha256(text), 1, 40) || chr(10) WHEN 3 THEN 'main' END AS c, CASE doc_id % 5 WHEN 0 THEN '2026-13-99T00:00:00Z' WHEN 1 THEN '2026-01-01T00:00:00Z' || chr(10) WHEN 2 THEN '2026-01-01 00:00:00Z' WHEN 3 THEN '2026-01-01T00:00:00Z' END AS u FROM documents) SELECT doc_id, coalesce(regexp_full_match(d, '[0-9a-f]{64}'), false) AS digest, coalesce(regexp_full_match(c, '[0-9a-fA-F]{40}'), false) AS commit, coalesce(regexp_full_match(u, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z'), false) AS utc FROM s",
)
def q108(spark, sf):
    i, sha = F.col("doc_id") % 5, F.sha2("text", 256)
    nl = lambda c: F.concat(c, F.lit("\n"))
    short = F.substring(sha, 1, 40)
    d = F.when(i == 0, sha).when(i == 1, F.upper(sha)).when(i == 2, nl(sha)).when(i == 3, F.substring(sha, 1, 63))
    c = F.when(i == 0, short).when(i == 1, F.upper(short)).when(i == 2, nl(short)).when(i == 3, "main")
    u = F.when(i == 0, "2026-13-99T00:00:00Z").when(i == 1, "2026-01-01T00:00:00Z\n").when(i == 2, "2026-01-01 00:00:00Z").when(i == 3, "2026-01-01T00:00:00Z")
    return table(spark, sf, "documents").select("doc_id", N.is_sha256(d).alias("digest"), N.is_commit(c).alias("commit"), N.is_utc(u).alias("utc"))


@query("q109_lenient_int", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id WHEN 1 THEN doc_id WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN -doc_id END AS i FROM documents")
def q109(spark, sf):
    i, t = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    text = F.when(i == 0, t).when(i == 1, F.concat(F.lit("  "), t, F.lit(" "))).when(i == 2, "true").when(i == 3, F.concat(t, F.lit(".5x"))).when(i == 4, F.concat(F.lit("-"), t))
    return table(spark, sf, "documents").select("doc_id", N.lenient_int(text).alias("i"))


@query("q110_human_bytes", "WITH b AS (SELECT doc_id, n_chars * (CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 1000000000000 END) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1024 ** 2 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1024 ** 3 THEN printf('%.2f MB', n / 1048576.0) WHEN n < 1024 ** 4 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END AS text FROM b")
def q110(spark, sf):
    i = F.col("doc_id") % 5
    n = F.col("n_chars") * F.when(i == 0, 1).when(i == 1, 1000).when(i == 2, 1_000_000).when(i == 3, 1_000_000_000).otherwise(1_000_000_000_000)
    return table(spark, sf, "documents").select("doc_id", N.human(n).alias("text"))


@query("q111_file_names", "SELECT doc_id, printf('layer-%03d.k%d.safetensors', doc_id % 1200, doc_id % 9) AS segment, printf('index-k%d.json', doc_id % 9) AS \"index\", printf('attestations/layer-%03d.k%d.jsonl', doc_id % 1200, doc_id % 9) AS attestation FROM documents")
def q111(spark, sf):
    layer, k = F.col("doc_id") % 1200, F.col("doc_id") % 9
    return table(spark, sf, "documents").select("doc_id", N.segment_name(layer, k).alias("segment"), N.index_name(k).alias("index"), N.attestation_name(layer, k).alias("attestation"))


@query("q112_int_set", "WITH s AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 7 + doc_id % 4 AS b, doc_id % 13 AS c FROM documents), x AS (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM s UNION SELECT doc_id, c FROM s) SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS ids FROM x GROUP BY 1")
def q112(spark, sf):
    i = F.col("doc_id")
    text = F.format_string(" %d-%d, %d ,,", i % 7, i % 7 + i % 4, i % 13)
    return table(spark, sf, "documents").select("doc_id", joined(N.int_set_column(text)).alias("ids"))


@query("q113_required_components", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'mcg,suh,svh,trellis' WHEN 1 THEN 'mcg,mul1,suh,svh,trellis' ELSE 'mul1,trellis' END AS comps FROM documents")
def q113(spark, sf):
    i = F.col("doc_id") % 3
    text = F.when(i == 0, "x.{suh|svh}").when(i == 1, "y.{suh|svh|mul1}.z").otherwise("plain")
    return table(spark, sf, "documents").select("doc_id", F.array_join(N.required_components(text, ["trellis"], F.when(i == 2, "mul1").otherwise("mcg")), ",").alias("comps"))


@query("q114_evidence_locator", "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'o%2F' || source || '%20~%2A%C3%A9@' || substr(sha256(text), 1, 40) || ':' || CASE WHEN doc_id % 4 = 1 THEN 'a%2Fb' ELSE '' END END AS locator FROM documents")
def q114(spark, sf):
    i = F.col("doc_id") % 4
    commit = F.substring(F.sha2("text", 256), 1, 40)
    revision = F.when(i == 2, F.upper(commit)).when(i != 3, commit).otherwise("main")
    return table(spark, sf, "documents").select("doc_id", N.locator_column(F.concat(F.lit("o/"), "source", F.lit(" ~*é")), revision, F.when(i == 1, "a/b")).alias("locator"))


@query("q115_blob_and_span_digests", "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS blob, sha256(encode(text)[3:40]) AS span FROM documents")
def q115(spark, sf):
    raw = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select("doc_id", D.git_blob(raw).alias("blob"), D.span_digest(raw, F.lit(2), F.least(F.lit(40), F.octet_length(raw))).alias("span"))


@query("q116_source_fingerprint", """SELECT doc_id, substr(sha256('{"layout":"' || lang || '","repo":"o/' || source || '","revision":"' || substr(sha256(text), 1, 40) || '","subdir":""}'), 1, 16) AS fp FROM documents""")
def q116(spark, sf):
    fp = D.source_fingerprint_column(repo=F.concat(F.lit("o/"), "source"), revision=F.substring(F.sha2("text", 256), 1, 40), subdir=F.lit(""), layout=F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", fp.alias("fp"))


@query("q117_file_and_span_digests", "SELECT doc_id, sha256(text) AS sha256, sha256(encode(text)[1:10]) || ',' || sha256(encode(text)[6:20]) AS spans FROM documents")
def q117(spark, sf):
    raw = F.encode("text", "UTF-8")
    size = F.octet_length(raw)
    cut = lambda a, b: F.struct(F.least(F.lit(a), size).alias("lo"), F.least(F.lit(b), size).alias("hi"))
    both = D.spans_of_file(raw, F.array(cut(0, 10), cut(5, 20)))
    return table(spark, sf, "documents").select("doc_id", both.alias("b")).select("doc_id", "b.sha256", F.array_join("b.spans", ",").alias("spans"))


@query("q118_trust_lines", "SELECT sha256(CAST(n_nationkey AS VARCHAR)) AS fingerprint, n_name AS key_id, 'active' AS status, CASE WHEN n_nationkey % 4 > 0 THEN '2026-01-01' ELSE '' END AS added, CASE WHEN n_nationkey % 4 = 2 THEN 'release' ELSE '' END AS role FROM nation WHERE n_nationkey % 5 <> 4 AND n_name NOT LIKE '% %'")
def q118(spark, sf):
    from fragmill.sources.documents import trust_lines

    i = F.col("n_nationkey")
    fp = F.sha2(i.cast("string"), 256)
    rest = F.when(i % 4 == 1, " 2026-01-01").when(i % 4 == 2, " 2026-01-01 release # note").when(i % 4 == 3, " 2026-01-01 ").otherwise("  # none")
    line = F.when(i % 5 == 4, F.concat(F.lit("# "), fp)).otherwise(F.concat(fp, F.lit("  "), "n_name", F.lit(" active"), rest))
    return trust_lines(table(spark, sf, "nation").where("n_name not like '% %'").select(line.alias("value")))


# -- analysis --------------------------------------------------------------------------------------------------


@query("q119_common_layers", f"WITH {CELLS} SELECT layer FROM e WHERE NOT (layer = 4 AND k = 2) GROUP BY 1 HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM e)")
def q119(spark, sf):
    return A.common_layers(cells(spark, sf).where("not (layer = 4 and k = 2)"))


@query("q120_allocation", f"WITH {BENEFIT}, t AS (SELECT * FROM b ORDER BY benefit DESC, layer, expert LIMIT {BUDGET}), c AS (SELECT layer, count(*) AS n FROM t GROUP BY 1) SELECT l.layer, coalesce(n, 0) AS n_upper, CAST({BUDGET / LAYERS} AS DOUBLE) AS uniform FROM (SELECT DISTINCT layer FROM b) l LEFT JOIN c ON l.layer = c.layer")
def q120(spark, sf):
    return A.allocation(gains(spark, sf), FRACTION, LAYERS, EXPERTS)
