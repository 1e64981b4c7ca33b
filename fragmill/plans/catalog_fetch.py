"""Registered queries of fetching, priming, assembling and releasing, with their SQL twins; stand-ins as in ``catalog``.

A document's fragment holds three tensors (ranks 0 to 2) that fill its span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.operators import allocate as A
from fragmill.operators import assemble as S
from fragmill.operators import fetch as H
from fragmill.operators import prime as M
from fragmill.operators import release as R
from fragmill.plans.catalog import BENEFIT, CELLS, EXPERTS, GINI, LAYERS, LIST, SPANS, cells, listing, query, r6, snapshot, spans, table

PARTS = f"""{SPANS}, ch AS (SELECT source_order AS layer, doc_id AS expert, source, lo + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS lo, hi + CASE WHEN doc_id % 10 IN (1, 2) THEN 1 ELSE 0 END AS hi, fragment AS sha256 FROM sp WHERE doc_id % 3 = 0),
 hd AS (SELECT source_order AS layer, doc_id AS expert, source, r AS rank, lo + n_chars // 3 * r AS t_lo, CASE WHEN r = 2 THEN hi ELSE lo + n_chars // 3 * (r + 1) END AS t_hi FROM sp, (SELECT unnest([0, 1, 2]) AS r) WHERE doc_id % 11 <> 5),
 hg AS (SELECT layer, expert, source, sum(t_hi - t_lo) AS held, min_by(t_lo, rank) AS first FROM hd GROUP BY 1, 2, 3),
 ju AS (SELECT ch.*, CASE WHEN held IS NULL THEN 'no tensors' WHEN held <> hi - lo THEN 'span' WHEN first <> lo THEN 'first offset' END AS rule FROM ch LEFT JOIN hg ON ch.layer = hg.layer AND ch.expert = hg.expert AND ch.source = hg.source)"""


def chosen(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    s = spans(spark, sf).where("doc_id % 3 = 0")
    lo = F.col("lo") + F.when(i % 10 == 2, 1).otherwise(0)
    hi = F.col("hi") + F.when((i % 10).isin(1, 2), 1).otherwise(0)
    return s.select(F.col("source_order").alias("layer"), F.lit(3).alias("k"), i.alias("expert"), "source", lo.alias("lo"), hi.alias("hi"), F.col("fragment").alias("sha256"))


def headers(spark, sf) -> DataFrame:
    s = spans(spark, sf).where("doc_id % 11 <> 5").withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2))))
    third = F.floor(F.col("size") / 3)
    part = [F.col("lo") + third * F.col("rank"), F.when(F.col("rank") == 2, F.col("hi")).otherwise(F.col("lo") + third * (F.col("rank") + 1))]
    name = F.concat_ws(".", F.col("doc_id").cast("string"), F.col("rank").cast("string"))
    return s.select("source", F.col("source_order").alias("layer"), F.lit(3).alias("k"), F.col("doc_id").alias("expert"), name.alias("name"), F.lit(0).alias("proj_ord"), "rank", F.lit(0).alias("comp_ord"), F.lit("U8").alias("dtype"), F.array(part[1] - part[0]).alias("shape"), part[0].alias("t_lo"), part[1].alias("t_hi"), F.lit(64).alias("body_offset"))


@query("q121_file_pieces", f"WITH {PARTS} SELECT layer, expert, source, lo + 64 AS start, hi + 64 AS stop, CAST(sum(hi - lo) OVER (PARTITION BY layer ORDER BY expert ROWS UNBOUNDED PRECEDING) - (hi - lo) AS BIGINT) AS local_off, sha256 FROM ju WHERE rule IS NULL")
def q121(spark, sf):
    return H.file_layout(chosen(spark, sf), headers(spark, sf))[0].select("layer", "expert", "source", "start", "stop", "local_off", "sha256")


@query("q122_file_tensors", f"WITH {PARTS} SELECT hd.layer, hd.expert, rank, t_lo, CAST(sum(t_hi - t_lo) OVER (PARTITION BY hd.layer ORDER BY hd.expert, rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_hi FROM hd JOIN ju ON hd.layer = ju.layer AND hd.expert = ju.expert AND hd.source = ju.source WHERE rule IS NULL")
def q122(spark, sf):
    return H.file_layout(chosen(spark, sf), headers(spark, sf))[1].select("layer", "expert", "rank", "t_lo", "new_hi")


@query("q123_layout_problems", f"WITH {PARTS} SELECT layer, expert, source, rule FROM ju WHERE rule IS NOT NULL")
def q123(spark, sf):
    return H.file_layout(chosen(spark, sf), headers(spark, sf))[2].drop("k")


@query("q124_resume_actions", f"WITH {SPANS} SELECT doc_id AS expert, CASE WHEN source_order % 5 IN (1, 2) OR doc_id % 4 = 3 THEN 'fetch' WHEN doc_id % 4 = 2 THEN 'refetch' ELSE 'keep' END AS action FROM sp")
def q124(spark, sf):
    p = spans(spark, sf).select(F.col("source_order").alias("layer"), F.lit(3).alias("k"), F.col("doc_id").alias("expert"), "sha256")
    i, layer = F.col("expert") % 4, F.col("layer")
    plans = p.select("layer", "k").distinct().withColumn("digest", F.sha2(layer.cast("string"), 256)).withColumn("stored_digest", F.when(layer % 5 == 1, "other").when(layer % 5 != 2, F.col("digest")))
    held = p.where("expert % 4 <> 3").withColumn("got", F.when(i == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return H.resume_actions(p, plans, held).select("expert", "action")


@query("q125_from_spool", f"WITH {SPANS} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'spool/' || doc_id END AS spooled FROM sp")
def q125(spark, sf):
    p = spans(spark, sf).select("doc_id", "source", F.col("lo").alias("start"), F.col("hi").alias("stop"), "size")
    spool = p.where("doc_id % 4 in (1, 2)").withColumn("path", F.concat(F.lit("spool/"), F.col("doc_id").cast("string"))).withColumn("size", F.when(F.col("doc_id") % 4 == 2, F.col("size") - 1).otherwise(F.col("size")))
    return H.from_spool(p, spool).select("doc_id", "spooled")


@query("q126_binding_digests", f"WITH {CELLS}, c AS (SELECT DISTINCT layer, expert FROM e) SELECT layer, expert, CASE WHEN expert % 3 = 1 THEN sha256(layer || '/' || expert) END AS bound FROM c")
def q126(spark, sf):
    c = cells(spark, sf).select("layer", "expert").distinct()
    bound = c.where("expert % 3 = 1").withColumn("sha256", F.sha2(F.concat_ws("/", F.col("layer").cast("string"), F.col("expert").cast("string")), 256))
    return H.binding_digests(c, bound.unionByName(c.limit(1).select("layer", F.lit(None).cast("long").alias("expert"), F.lit("m").alias("sha256"))))


@query(
    "q127_index_documents",
    f"""WITH {SPANS}, r AS (SELECT CASE k WHEN 'en' THEN 3 ELSE 4 END AS k, CAST(source_order AS BIGINT) AS layer, string_agg('"' || doc_id || '":[' || lo || ',' || hi || ']', ',' ORDER BY CAST(doc_id AS VARCHAR)) AS experts, sha256(source) AS sha FROM sp WHERE doc_id % 7 = 0 GROUP BY 1, 2, source), d AS (SELECT k, '{{' || string_agg('"' || layer || '":{{"body_offset":64,"experts":{{' || experts || '}},"file":"' || printf('layer-%03d.k%d.safetensors', layer, k) || '","sha256":"' || sha || '","size":9}}', ',' ORDER BY CAST(layer AS VARCHAR)) || '}}' AS document FROM r GROUP BY 1) SELECT k, printf('index-k%d.json', k) AS name, document FROM d""",
)
def q127(spark, sf):
    k = F.when(F.col("k") == "en", 3).otherwise(4)
    e = spans(spark, sf).where("doc_id % 7 = 0").select(F.col("source_order").alias("layer"), k.alias("k"), F.sha2("source", 256).alias("sha256"), F.lit(9).alias("size"), F.lit(64).alias("body_offset"), F.col("doc_id").alias("expert"), "lo", "hi")
    return H.index_documents(e.withColumn("file", F.format_string("layer-%03d.k%d.safetensors", "layer", "k")))


@query("q128_subset_manifest", f"WITH {SPANS}, p AS (SELECT source_order AS layer, CASE k WHEN 'en' THEN 3 ELSE 4 END AS k, doc_id AS expert, source FROM sp WHERE doc_id % 5 = 0), n AS (SELECT layer, count(DISTINCT expert) AS n FROM p GROUP BY 1) SELECT array_to_string(list(DISTINCT k ORDER BY k), ',') AS k_variants, min(layer) AS layer_lo, max(layer) AS layer_hi, array_to_string(list(DISTINCT source ORDER BY source), ',') AS sources, (SELECT max(n) FROM n) AS num_experts FROM p")
def q128(spark, sf):
    p = spans(spark, sf).where("doc_id % 5 = 0").select(F.col("source_order").alias("layer"), F.when(F.col("k") == "en", 3).otherwise(4).alias("k"), F.col("doc_id").alias("expert"), "source")
    m = H.subset_manifest(p)
    return m.select(F.array_join(F.transform("k_variants", lambda x: x.cast("string")), ",").alias("k_variants"), "layer_lo", "layer_hi", F.array_join("sources", ",").alias("sources"), "num_experts")


def used(spark, sf) -> DataFrame:
    return spans(spark, sf).where("doc_id % 4 = 0").select((F.col("source_order") % 3).alias("layer"), F.when(F.col("k") == "en", 3).otherwise(4).alias("k"), F.col("doc_id").alias("expert"), "source", "sha256", "source_order")


def release_cover(spark, sf) -> DataFrame:
    return used(spark, sf).select("source", "layer", "k", (F.col("source_order") % 2 == 0).alias("covered")).distinct().where("k = 3")


USED = f"{SPANS}, us AS (SELECT source_order % 3 AS layer, CASE k WHEN 'en' THEN 3 ELSE 4 END AS k, doc_id AS expert, source, fragment AS sha256, source_order FROM sp WHERE doc_id % 4 = 0)"


@query("q129_provenance", f"WITH {USED} SELECT layer, k, expert, source, sha256, (k = 3 AND source_order % 2 = 0) AS release_covered FROM us")
def q129(spark, sf):
    return H.provenance(used(spark, sf), release_cover(spark, sf))


@query("q130_evidence_copies", f"WITH {USED}, u AS (SELECT DISTINCT source, layer, k, source_order FROM us), l AS (SELECT source, 'attestations/' || printf('layer-%03d.k%d.jsonl', layer, k) AS origin, 'attestations/o%2F' || source || '/' || printf('layer-%03d.k%d.jsonl', layer, k) AS target FROM u) SELECT * FROM l UNION ALL SELECT DISTINCT source, 'release.json', 'attestations/o%2F' || source || '/release.json' FROM u WHERE k = 3 AND source_order % 2 = 0")
def q130(spark, sf):
    u = used(spark, sf)
    return H.evidence_copies(u, u.select("source", F.concat(F.lit("o%2F"), "source").alias("locator")).distinct(), release_cover(spark, sf))


@query(
    "q131_derived_payloads",
    f"""WITH {USED}, x AS (SELECT layer, k, source, '[' || string_agg(CAST(expert AS VARCHAR), ',' ORDER BY expert) || ']' AS experts FROM us GROUP BY 1, 2, 3), p AS (SELECT layer, k, string_agg('{{"source":"' || source || '","repo":"o/' || source || '","revision":"' || sha1(source) || '","file":"f","sha256":"' || sha256(source) || '","size":7,"keyid":"kk","predicate":"repack-of","experts":' || experts || ',"header_method":"digest","release_covered":true}}', ',' ORDER BY source) AS parents FROM x GROUP BY 1, 2), e AS (SELECT layer, k, string_agg('"' || expert || '":"' || sha256 || '"', ',' ORDER BY CAST(expert AS VARCHAR)) AS ex, count(*) AS n FROM us GROUP BY 1, 2) SELECT p.layer, p.k, '{{"predicate":"derived-from","fragment":{{"file":"' || printf('layer-%03d.k%d.safetensors', p.layer, p.k) || '","sha256":"s","size":5,"header_sha256":"h","body_offset":64}},"expert_sha256":{{' || ex || '}},"layer":' || p.layer || ',"k":' || p.k || ',"num_experts":' || n || ',"parents":[' || parents || ']}}' AS payload FROM p JOIN e ON p.layer = e.layer AND p.k = e.k""",
)
def q131(spark, sf):
    u = used(spark, sf)
    landed = u.select("layer", "k").distinct().select("layer", "k", F.format_string("layer-%03d.k%d.safetensors", "layer", "k").alias("file"), F.lit("s").alias("sha256"), F.lit(5).alias("size"), F.lit("h").alias("header_sha256"), F.lit(64).alias("body_offset"))
    parents = u.select("source", "layer", "k").distinct().select("*", F.concat(F.lit("o/"), "source").alias("repo"), F.sha1("source").alias("revision"), F.lit("f").alias("file"), F.sha2("source", 256).alias("sha256"), F.lit(7).alias("size"), F.lit("kk").alias("keyid"), F.lit("repack-of").alias("predicate"), F.lit("digest").alias("header_method"), F.lit(True).alias("release_covered"))
    return H.derived_payloads(u, landed, parents).withColumn("payload", F.to_json("payload"))


@query("q132_changed_documents", "SELECT CAST(doc_id AS VARCHAR) AS name, text AS document FROM documents WHERE doc_id % 5 IN (1, 2)")
def q132(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("text").alias("document"))
    old = d.where("doc_id % 5 <> 1").withColumn("document", F.when(F.col("doc_id") % 5 == 2, F.concat("document", F.lit(" "))).otherwise(F.col("document")))
    return H.changed_documents(d.drop("doc_id"), old)


@query("q133_header_cache_row", "SELECT doc_id, source AS header, base64(encode(lang)) AS header_bytes, CAST(octet_length(encode(lang)) AS INTEGER) AS body_offset FROM documents")
def q133(spark, sf):
    raw = F.encode("lang", "UTF-8")
    return table(spark, sf, "documents").select("doc_id", H.header_cache_row(F.col("source"), raw, F.octet_length(raw)).alias("r")).select("doc_id", "r.*")


EVIDENCE = """ev AS (SELECT doc_id AS parent, doc_id % 13 AS m, sha1(source) AS rev, source, sha256(text) AS sha, n_chars AS size, sha256(lang) AS att FROM documents)"""


@query(
    "q134_parent_release_rules",
    f"WITH {EVIDENCE} SELECT parent, CASE m WHEN 1 THEN 'no claim' WHEN 2 THEN 'invalid claim' WHEN 3 THEN 'not available offline' WHEN 4 THEN 'invalid binding' WHEN 5 THEN 'missing or replaced' WHEN 6 THEN 'invalid evidence' WHEN 7 THEN 'identity' WHEN 8 THEN 'identity' WHEN 9 THEN 'fragment' WHEN 10 THEN 'fragment' WHEN 11 THEN 'attestation' ELSE 'verified' END AS reason FROM ev",
)
def q134(spark, sf):
    m = F.col("m")
    e = table(spark, sf, "documents").select(F.col("doc_id").alias("parent"), (F.col("doc_id") % 13).alias("m"), F.sha1("source").alias("rev"), "source", F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"), F.sha2("lang", 256).alias("att"))
    parents = e.select(
        "parent", (m != 1).alias("claim"), F.when(m != 2, "key").alias("keyid"), F.col("source").alias("repo"), F.col("rev").alias("revision"), F.lit("f").alias("file"), F.col("sha").alias("sha256"), "size", F.lit("a").alias("attestation"), F.col("att").alias("attestation_sha256"), F.lit(3).alias("attestation_size"),
        F.when(m != 3, "release.json").alias("e_file"), F.when(m == 4, "no digest").otherwise(F.col("att")).alias("e_sha256"), F.lit(9).alias("e_size"), F.col("source").alias("e_repo"), F.when(m == 7, F.sha1(F.lit("x"))).otherwise(F.col("rev")).alias("e_revision"), F.col("rev").alias("e_source_revision"),
    )
    copied = F.when(m == 4, "no digest").otherwise(F.col("att"))
    envelopes = e.where(m != 5).select("parent", copied.alias("copied_sha256"), F.lit(9).alias("copied_size"), (m != 6).alias("verified"), F.when(m == 8, "other").otherwise(F.col("source")).alias("r_repo"), F.when(m % 2 == 0, F.upper("rev")).alias("r_revision"), F.when(m % 2 == 1, F.col("rev")).alias("r_parent_revision"))
    fragments = e.where(m != 9).select("parent", F.lit("f").alias("path"), F.col("sha").alias("sha256"), F.when(m == 10, -1).otherwise(F.col("size")).alias("size"))
    lines = e.select("parent", F.lit("a").alias("path"), F.when(m == 11, "x").otherwise(F.col("att")).alias("sha256"), F.lit(3).cast("long").alias("size"))
    return H.parent_release_rules(parents, envelopes, fragments.union(lines))


# -- priming ---------------------------------------------------------------------------------------------------


def routed(spark, sf) -> DataFrame:
    """Tensors of a source: an expert per document with four ranks of one packed tensor; some are broken."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 20).alias("layer"), F.col("doc_id").alias("expert"))
    t = d.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(3))))
    t = t.where("not (doc_id % 17 = 1 and rank = 2)")
    shape = F.array(F.lit(1), F.lit(2), F.when(F.col("doc_id") % 17 == 2, 17).otherwise(48))
    return t.select("layer", "expert", F.lit("up_proj").alias("proj"), "rank", F.lit("trellis").alias("comp"), F.when(F.col("doc_id") % 17 == 3, "F16").otherwise("I16").alias("dtype"), shape.alias("shape"))


@query(
    "q135_preflight",
    "WITH d AS (SELECT doc_id % 20 AS layer, doc_id AS expert, doc_id % 17 AS m FROM documents), t AS (SELECT * FROM d WHERE layer < 5 OR (layer < 9 AND expert % 2 = 0)), r AS (SELECT layer, expert, CASE WHEN m = 1 THEN 'ranks' WHEN m IN (2, 3) THEN 'packed shape' END AS rule FROM t) SELECT CAST(layer AS INTEGER) AS layer, CAST(expert AS INTEGER) AS expert, rule FROM r WHERE rule IS NOT NULL UNION ALL SELECT CAST(layer AS INTEGER), -1, 'no such expert' FROM (SELECT DISTINCT layer FROM d WHERE layer BETWEEN 5 AND 8) UNION ALL SELECT NULL, NULL, 'tp'",
)
def q135(spark, sf):
    t = routed(spark, sf)
    layers = t.select("layer").distinct()
    targets = layers.where("layer < 5").select("layer", F.lit(None).cast("long").alias("expert"))
    targets = targets.union(t.where("layer between 5 and 8 and expert % 2 = 0").select("layer", "expert")).union(layers.where("layer between 5 and 8").select("layer", F.lit(-1).cast("long")))
    config = table(spark, sf, "nation").where("n_nationkey = 0").select(F.lit('"4"').alias("tp"))
    return M.preflight(t, config, "rank_sliced_tp4", targets)


@query("q136_segment_layout", f"WITH {SPANS}, t AS (SELECT source_order AS layer, CASE k WHEN 'en' THEN 3 WHEN 'de' THEN 4 ELSE 5 END AS k, doc_id AS expert, lo, n_chars AS size FROM sp) SELECT layer, k, expert, lo, CAST(sum(size) OVER (PARTITION BY layer, k ORDER BY expert ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_hi FROM t WHERE k IN (3, 4)")
def q136(spark, sf):
    return M.segment_layout(source_tensors(spark, sf), [3, 4]).select("layer", "k", "expert", "lo", "new_hi")


def source_tensors(spark, sf) -> DataFrame:
    k = F.when(F.col("k") == "en", 3).when(F.col("k") == "de", 4).otherwise(5)
    return spans(spark, sf).select(F.col("source_order").alias("layer"), k.alias("k"), F.col("doc_id").alias("expert"), F.col("source").alias("path"), "lo", "hi", F.lit(0).alias("proj_ord"), F.lit(0).alias("rank"), F.lit(0).alias("comp_ord"), F.col("doc_id").cast("string").alias("name"))


def ranges_sql(cap: int) -> str:
    return f"""WITH RECURSIVE {SPANS}, o AS (SELECT source, lo, hi, row_number() OVER (PARTITION BY source ORDER BY lo, hi) AS n FROM sp WHERE k IN ('en', 'de')),
 f AS (SELECT source, n, lo AS start, hi AS stop, 1 AS req FROM o WHERE n = 1 UNION ALL SELECT o.source, o.n, CASE WHEN o.lo = f.stop AND o.hi - f.start <= {cap} THEN f.start ELSE o.lo END, o.hi, CASE WHEN o.lo = f.stop AND o.hi - f.start <= {cap} THEN f.req ELSE f.req + 1 END FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
 SELECT f.source AS path, min(o.lo) AS start, max(o.hi) AS stop, count(*) AS n_pieces FROM f JOIN o ON f.source = o.source AND f.n = o.n GROUP BY f.source, f.req"""


@query("q137_source_ranges", ranges_sql(30000))
def q137(spark, sf):
    return M.source_ranges(M.segment_layout(source_tensors(spark, sf), [3, 4]), 30000).select("path", "start", "stop", "n_pieces")


@query("q138_prime_need", f"""WITH {SPANS}, t AS (SELECT source_order AS layer, CASE k WHEN 'en' THEN 3 WHEN 'de' THEN 4 ELSE 5 END AS k, doc_id, n_chars FROM sp), c AS (SELECT layer, k, count(DISTINCT doc_id) AS n FROM t GROUP BY 1, 2), j AS (SELECT layer, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS experts FROM c GROUP BY 1), b AS (SELECT layer, sum(CASE WHEN k IN (3, 4) THEN n_chars ELSE 0 END) + sum(CASE WHEN doc_id % 50 = 0 THEN n_chars ELSE 0 END) AS bytes FROM t GROUP BY 1) SELECT b.layer, CAST(bytes AS BIGINT) AS bytes, experts FROM b JOIN j ON b.layer = j.layer""")
def q138(spark, sf):
    t = source_tensors(spark, sf)
    return M.need(t, t.where("expert % 50 = 0"), [3, 4])


def told(i) -> dict:
    return {"repo": F.concat(F.lit("o/"), "source"), "revision": F.lit("r"), "file": F.col("lang"), "base_model": F.lit("m"), "file_sha256": F.when(i % 3 != 0, F.sha2("source", 256))}


@query("q139_segment_metadata", """SELECT doc_id, 'base_model=m;k=' || doc_id % 5 || ';layer=' || doc_id % 9 || ';layout=l;num_experts=8;predicate=repack-of;source_file=' || lang || CASE WHEN doc_id % 3 <> 0 THEN ';source_file_sha256=' || sha256(source) ELSE '' END || ';source_repo=o/' || source || ';source_revision=r' AS meta FROM documents""")
def q139(spark, sf):
    i = F.col("doc_id")
    meta = M.segment_metadata(told(i), i % 9, F.lit("l"), F.lit(8), k=i % 5)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return table(spark, sf, "documents").select("doc_id", text.alias("meta"))


@query("q140_statement", """SELECT doc_id, '{"predicate":"repack-of","fragment":{"file":"' || lang || '","sha256":"' || sha256(text) || '","size":' || n_chars || '},"materials":{"repo":"o/' || source || '","revision":"r","file":"' || lang || '"' || CASE WHEN doc_id % 3 <> 0 THEN ',"file_sha256":"' || sha256(source) || '"' ELSE '' END || '},"layout":"l","base_model":"m","source_config":{"tp":"4"},"created_utc":"2026-01-01T00:00:00Z"}' AS payload FROM documents""")
def q140(spark, sf):
    said = M.statement(told(F.col("doc_id")), F.lit("l"), F.col("lang"), F.sha2("text", 256), F.col("n_chars"), F.create_map(F.lit("tp"), F.lit("4")), F.lit(None).cast("string"), F.lit("2026-01-01T00:00:00Z"))
    return table(spark, sf, "documents").select("doc_id", F.to_json(said).alias("payload"))


# -- assembly, release, analysis -------------------------------------------------------------------------------


@query(
    "q141_shard_pieces",
    f"WITH {SPANS}, o AS (SELECT doc_id, source, lo, CASE WHEN doc_id % 4 = 1 THEN n_chars * 2 ELSE n_chars END AS size FROM sp), l AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY lo, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_hi FROM o) SELECT source AS file, doc_id, CASE WHEN doc_id % 4 = 1 THEN 'segment' ELSE source END AS path, CASE WHEN doc_id % 4 = 1 THEN doc_id * 10 ELSE 64 + lo END AS start, CASE WHEN doc_id % 4 = 1 THEN doc_id * 10 ELSE 64 + lo END + size AS stop, new_hi - size AS local_off FROM l",
)
def q141(spark, sf):
    s = spans(spark, sf).withColumn("layer", F.col("source_order")).withColumn("expert", F.col("doc_id"))
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name")
    src = s.select(F.col("source").alias("shard"), "layer", "expert", name, "lo", "hi", "doc_id")
    seg = s.where("doc_id % 4 = 1").select("layer", "expert", F.lit(4).alias("k"), name, (F.col("size") * 2).alias("size"), F.lit("I16").alias("dtype"))
    made = S.override_join(src, seg.select("layer", "expert", "k"), seg)
    made = made.withColumns({"dtype": F.lit("U8"), "shape": F.array(F.col("new_size")), "source_path": F.col("shard"), "source_offset": F.lit(64), "segment_path": F.lit("segment"), "segment_lo": F.col("doc_id") * 10})
    return S.shard_pieces(made)[0].select("file", F.col("name").cast("long").alias("doc_id"), "path", "start", "stop", "local_off")


@query(
    "q142_assembly_record",
    f"""WITH {CELLS}, m AS (SELECT layer, expert, min(k) AS k FROM e GROUP BY 1, 2), f AS (SELECT DISTINCT layer, k FROM m WHERE layer < 3) SELECT '{{"predicate":"assembly-of","recipe":{{"sha256":"rr","k_values":' || (SELECT '[' || string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) || ']' FROM (SELECT DISTINCT k FROM m)) || ',"layers":' || (SELECT '[' || string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) || ']' FROM (SELECT DISTINCT layer FROM m)) || ',"layers_assembled":' || (SELECT '[' || string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) || ']' FROM (SELECT DISTINCT layer FROM f)) || '}},"materials":{{"fragments":[' || (SELECT string_agg('{{"layer":' || layer || ',"k":' || k || ',"file":"' || printf('layer-%03d.k%d.safetensors', layer, k) || '","sha256":"' || sha256(layer || '/' || k) || '","size":' || (layer + k) || '}}', ',' ORDER BY layer, k) FROM f) || ']}},"products":[' || (SELECT string_agg('{{"file":"' || layer || '","sha256":"' || sha256(CAST(layer AS VARCHAR)) || '"}}', ',' ORDER BY CAST(layer AS VARCHAR)) FROM (SELECT DISTINCT layer FROM f)) || ']}}' AS record""",
)
def q142(spark, sf):
    m = cells(spark, sf).groupBy("layer", "expert").agg(F.min("k").alias("k"))
    f = m.where("layer < 3").select("layer", "k").distinct()
    text = F.col("layer").cast("string")
    fragments = f.select("layer", "k", F.format_string("layer-%03d.k%d.safetensors", "layer", "k").alias("file"), F.sha2(F.concat_ws("/", text, F.col("k").cast("string")), 256).alias("sha256"), (F.col("layer") + F.col("k")).alias("size"))
    layers = f.select("layer").distinct()
    return S.assembly_record(m, layers, fragments, layers.select(text.alias("file"), F.sha2(text, 256).alias("sha256")), "rr", None).select(F.to_json("record").alias("record"))


@query(
    "q143_release_payload",
    f"""WITH {LIST}, f AS (SELECT path, sha, size FROM a WHERE doc_id % 3 = 0 UNION ALL SELECT 'manifest.json', 'mm', 4) SELECT '{{"schema":"s/1","release":"r1","created_utc":"2026-01-01T00:00:00Z","counts":{{"files":' || count(*) || ',"fragments":' || count(*) FILTER (WHERE path LIKE '%.safetensors') || ',"bytes":' || CAST(sum(size) AS BIGINT) || '}},"files":{{' || string_agg('"' || path || '":{{"sha256":"' || sha || '","size":' || size || '}}', ',' ORDER BY path) || '}},"manifest_sha256":"mm","repo":"o/r"}}' AS payload FROM f""",
)
def q143(spark, sf):
    files = listing(spark, sf).where("doc_id % 3 = 0").select("path", "sha256", F.col("size").cast("long").alias("size"))
    files = files.union(table(spark, sf, "nation").where("n_nationkey = 0").select(F.lit("manifest.json"), F.lit("mm"), F.lit(4).cast("long")))
    return R.build_payload(files, "s/1", "r1", F.lit("2026-01-01T00:00:00Z"), repo="o/r").select(F.to_json("payload").alias("payload"))


B25, B42 = (A.budget_of(f, LAYERS * EXPERTS) for f in (0.25, 0.42))


def analysis_sql() -> str:
    budgets = []
    for f, b in ((0.25, B25), (0.42, B42)):
        budgets.append(
            f"SELECT 'budget {f}' AS part, NULL::BIGINT AS layer, unnest(['captured', 'even', 'least', 'most']) AS name, unnest([s, u, CAST(lo AS DOUBLE), CAST(hi AS DOUBLE)]) AS value FROM (SELECT sum(coalesce(s, 0)) AS s, min(coalesce(n, 0)) AS lo, max(coalesce(n, 0)) AS hi FROM (SELECT DISTINCT layer FROM b) l LEFT JOIN (SELECT layer, count(*) AS n, sum(benefit) AS s FROM (SELECT * FROM b ORDER BY benefit DESC, layer, expert LIMIT {b}) GROUP BY 1) c ON l.layer = c.layer), "
            f"(SELECT sum(benefit) AS u FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY benefit DESC, expert) AS n FROM b) r JOIN (SELECT layer, least({b // LAYERS} + CASE WHEN row_number() OVER (ORDER BY layer) - 1 < {b % LAYERS} THEN 1 ELSE 0 END, {EXPERTS}) AS take FROM (SELECT DISTINCT layer FROM b)) q ON r.layer = q.layer WHERE n <= take)"
        )
    return f"""WITH {BENEFIT}{GINI}, v AS (SELECT layer, stddev_pop(delta) / greatest(abs(avg(delta)), 1e-12) AS cv FROM b GROUP BY 1), w AS (SELECT v.layer, cv, gini FROM v JOIN g ON v.layer = g.layer), a AS (
 SELECT 'means' AS part, NULL::BIGINT AS layer, 'k' || k AS name, avg(eps) AS value FROM e GROUP BY k
 UNION ALL SELECT 'k3 to k4', layer, 'delta_cv', cv FROM w UNION ALL SELECT 'k3 to k4', layer, 'gini', gini FROM w
 UNION ALL SELECT 'k3 to k4', NULL, 'median_cv', median(cv) FROM w UNION ALL SELECT 'k3 to k4', NULL, 'median_gini', median(gini) FROM w
 UNION ALL SELECT 'k3 to k4', NULL, 'fires', CAST(median(cv) < 0.1 AND median(gini) < 0.2 AS DOUBLE) FROM w
 UNION ALL {' UNION ALL '.join(budgets)}) SELECT part, layer, name, round(value, 4) AS value FROM a"""


@query("q144_error_analysis", analysis_sql())
def q144(spark, sf):
    out = A.analysis(cells(spark, sf), [(3, 4)], [0.25, 0.42], LAYERS, EXPERTS)
    return out.where("name not in ('top_share', 'advantage')").withColumn("value", F.round("value", 4))


@query("q145_remote_listing", f"WITH {LIST} SELECT b.path, CASE WHEN b.doc_id % 2 = 0 THEN b.sha END AS lfs, b.size FROM b")
def q145(spark, sf):
    from fragmill.sources.documents import remote_listing

    lfs = F.when(F.col("doc_id") % 2 == 0, F.struct("sha256"))
    file = F.struct(F.col("path").alias("rfilename"), "size", F.lit("b").alias("blob_id"), lfs.alias("lfs"))
    pages = snapshot(spark, sf).groupBy(F.floor(F.col("doc_id") / 100)).agg(F.to_json(F.struct(F.collect_list(file).alias("siblings"))).alias("value"))
    return remote_listing(pages).select("path", "lfs", "size")


@query("q146_budget_beyond_a_sort", f"WITH {CELLS}, c AS (SELECT layer, expert, eps AS benefit FROM e WHERE k = 3) SELECT layer, expert, round(benefit, 6) AS benefit FROM c ORDER BY c.benefit DESC, layer, expert LIMIT 251")
def q146(spark, sf):
    c = cells(spark, sf).where("k = 3").select("layer", "expert", F.col("eps").alias("benefit"))
    most, A.MOST_SORTED = A.MOST_SORTED, 10
    try:
        return A.budget_solve(c, 251).withColumn("benefit", r6("benefit"))
    finally:
        A.MOST_SORTED = most
