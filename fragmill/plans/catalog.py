"""Registered queries over the driver's tables and their SQL twins.

Stand-ins: documents are fragments (provider = source in the order of its number, tier = lang, span = running
n_chars of the source by doc_id, digest = sha256 of the text); lineitem gives cells (tier = l_linenumber,
layer = l_suppkey % 10, expert = l_partkey % 64); labels of quality 1 are the wanted set; embeddings are
decoded vectors; events.props are JSON documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fragmill.functions import digest as D
from fragmill.functions import metrics as M
from fragmill.operators import allocate as A
from fragmill.operators import assemble as S
from fragmill.operators import checks as C
from fragmill.operators import layout as L
from fragmill.operators import plan as P
from fragmill.operators import release as R
from fragmill.operators import state as T
from fragmill.operators import trust as U
from fragmill.operators import verify as V

QUERIES: dict = {}
ORACLES: dict = {}
LAYERS, EXPERTS, LO, HI = 10, 64, 3, 4
FRACTION = 0.42


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# -- cells ---------------------------------------------------------------------------------------------------

CELLS = """e AS (SELECT CAST(l_linenumber AS BIGINT) AS k, CAST(l_suppkey % 10 AS BIGINT) AS layer, CAST(l_partkey % 64 AS BIGINT) AS expert,
 CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS eps, count(*) AS phi FROM lineitem GROUP BY 1, 2, 3)"""
BENEFIT = (
    CELLS
    + """, p AS (SELECT layer, expert, max(CASE WHEN k = 3 THEN eps END) AS e_lo, max(CASE WHEN k = 4 THEN eps END) AS e_hi, max(CASE WHEN k = 3 THEN phi END) AS phi FROM e WHERE k IN (3, 4) GROUP BY 1, 2),
 b AS (SELECT layer, expert, e_lo - e_hi AS delta, phi / greatest(sum(phi) OVER (PARTITION BY layer), 1) AS share, (e_lo - e_hi) * (phi / greatest(sum(phi) OVER (PARTITION BY layer), 1)) AS benefit FROM p WHERE e_lo IS NOT NULL AND e_hi IS NOT NULL)"""
)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    key = [F.col("l_linenumber").cast("long").alias("k"), (F.col("l_suppkey") % 10).cast("long").alias("layer"), (F.col("l_partkey") % 64).cast("long").alias("expert")]
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    return li.groupBy(*key).agg((cents.cast("double") / F.count("*")).alias("eps"), F.count("*").alias("phi"))


def gains(spark: SparkSession, sf: str) -> DataFrame:
    return A.benefit(cells(spark, sf), LO, HI)


@query("q01_eps_cells", f"WITH {CELLS} SELECT k, layer, expert, round(eps, 6) AS eps, phi FROM e")
def q01(spark, sf):
    return cells(spark, sf).withColumn("eps", r6("eps"))


@query("q01b_dense_violations", f"WITH {CELLS} SELECT k, layer, count(*) AS cells, count(DISTINCT expert) AS ids, min(expert) AS lo, max(expert) AS hi FROM e GROUP BY 1, 2 HAVING NOT (count(*) = 64 AND count(DISTINCT expert) = 64 AND min(expert) = 0 AND max(expert) = 63)")
def q01b(spark, sf):
    return A.dense_violations(cells(spark, sf), EXPERTS).drop("nulls")


@query("q02_mean_eps_per_tier", f"WITH {CELLS} SELECT k, round(avg(eps), 6) AS mean_eps FROM e GROUP BY 1")
def q02(spark, sf):
    return A.mean_error(cells(spark, sf)).select("k", r6("mean_eps").alias("mean_eps"))


@query("q03_benefit_share", f"WITH {BENEFIT} SELECT layer, expert, round(delta, 6) AS delta, round(share, 6) AS share, round(benefit, 6) AS benefit FROM b")
def q03(spark, sf):
    return gains(spark, sf).select("layer", "expert", *(r6(c).alias(c) for c in ("delta", "share", "benefit")))


@query("q04_delta_cv", f"WITH {BENEFIT} SELECT layer, round(avg(delta), 6) AS delta_mean, round(stddev_pop(delta) / greatest(abs(avg(delta)), 1e-12), 4) AS delta_cv FROM b GROUP BY 1")
def q04(spark, sf):
    return A.variation(gains(spark, sf)).select("layer", r6("delta_mean").alias("delta_mean"), F.round("delta_cv", 4).alias("delta_cv"))


GINI = """, x AS (SELECT layer, expert, greatest(benefit, 0.0) AS x FROM b), y AS (SELECT layer, x, sum(x) OVER (PARTITION BY layer ORDER BY x, expert ROWS UNBOUNDED PRECEDING) AS cum FROM x),
 g AS (SELECT layer, CASE WHEN sum(x) = 0 THEN 0.0 ELSE (count(*) + 1 - 2 * (sum(cum) / sum(x))) / count(*) END AS gini FROM y GROUP BY 1)"""


@query("q05_benefit_gini", f"WITH {BENEFIT}{GINI} SELECT layer, round(gini, 6) AS gini FROM g")
def q05(spark, sf):
    return A.gini(gains(spark, sf)).select("layer", r6("gini").alias("gini"))


@query("q06_top16_share", f"WITH {BENEFIT}, r AS (SELECT layer, abs(benefit) AS benefit, row_number() OVER (PARTITION BY layer ORDER BY abs(benefit) DESC, expert) AS n FROM b) SELECT layer, round(sum(CASE WHEN n <= 16 THEN benefit ELSE 0 END) / greatest(sum(benefit), 1e-18), 6) AS top_share FROM r GROUP BY 1")
def q06(spark, sf):
    g = gains(spark, sf).withColumn("benefit", F.abs("benefit"))
    return A.top_share(g).withColumn("top_share", r6("top_share"))


@query(
    "q07_abort_verdict",
    f"WITH {BENEFIT}{GINI}, v AS (SELECT layer, stddev_pop(delta) / greatest(abs(avg(delta)), 1e-12) AS cv FROM b GROUP BY 1) SELECT round(median(cv), 4) AS median_cv, round(median(gini), 4) AS median_gini, (median(cv) < 0.1 AND median(gini) < 0.2) AS fires FROM v JOIN g USING (layer)",
)
def q07(spark, sf):
    return A.abort_verdict(gains(spark, sf)).select(F.round("median_cv", 4).alias("median_cv"), F.round("median_gini", 4).alias("median_gini"), "fires")


BUDGET = A.budget_of(FRACTION, LAYERS * EXPERTS)


@query("q08_budget_solve", f"WITH {BENEFIT}, t AS (SELECT * FROM b ORDER BY benefit DESC, layer, expert LIMIT {BUDGET}), c AS (SELECT layer, count(*) AS n, sum(benefit) AS s FROM t GROUP BY 1) SELECT l.layer, coalesce(n, 0) AS n_upper, round(coalesce(s, 0), 6) AS captured FROM (SELECT DISTINCT layer FROM b) l LEFT JOIN c ON l.layer = c.layer")
def q08(spark, sf):
    return A.upgrades_per_layer(gains(spark, sf), BUDGET).withColumn("captured", r6("captured"))


@query(
    "q09_uniform_baseline",
    f"WITH {BENEFIT}, r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY benefit DESC, expert) AS n FROM b), q AS (SELECT layer, least({BUDGET // LAYERS} + CASE WHEN row_number() OVER (ORDER BY layer) - 1 < {BUDGET % LAYERS} THEN 1 ELSE 0 END, {EXPERTS}) AS take FROM (SELECT DISTINCT layer FROM b)) SELECT layer, count(*) FILTER (WHERE n <= take) AS n_upper, round(sum(CASE WHEN n <= take THEN benefit ELSE 0 END), 6) AS captured FROM r JOIN q USING (layer) GROUP BY 1",
)
def q09(spark, sf):
    return A.uniform_baseline(gains(spark, sf), BUDGET, LAYERS, EXPERTS).withColumn("captured", r6("captured"))


@query(
    "q10_concentration_curve",
    f"WITH {BENEFIT}, pos AS (SELECT layer, expert, abs(benefit) AS benefit FROM b), r AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY benefit DESC, expert) AS rank, sum(benefit) OVER (PARTITION BY layer ORDER BY benefit DESC, expert ROWS UNBOUNDED PRECEDING) / sum(benefit) OVER (PARTITION BY layer) AS share FROM pos) SELECT CAST(rank AS BIGINT) AS rank, round(median(share), 6) AS mid, round(min(share), 6) AS low, round(max(share), 6) AS high FROM r GROUP BY 1",
)
def q10(spark, sf):
    g = gains(spark, sf).withColumn("benefit", F.abs("benefit"))
    return A.concentration_curve(g).select(F.col("rank").cast("long").alias("rank"), *(r6(c).alias(c) for c in ("mid", "low", "high")))


@query("q11_tier_ladder", f"WITH {CELLS}, m AS (SELECT k, avg(eps) AS mean_eps FROM e GROUP BY 1) SELECT k, round(mean_eps / lead(mean_eps) OVER (ORDER BY k), 6) AS ratio, round(sqrt(mean_eps * lead(mean_eps) OVER (ORDER BY k)), 6) AS midpoint FROM m")
def q11(spark, sf):
    return A.error_ladder(A.mean_error(cells(spark, sf))).select("k", r6("ratio").alias("ratio"), r6("midpoint").alias("midpoint"))


# -- fragments -----------------------------------------------------------------------------------------------

SPANS = """s AS (SELECT doc_id, source, CAST(substr(source, 4) AS BIGINT) AS source_order, lang AS k, sha256(text) AS fragment, n_chars,
 CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM documents),
 sp AS (SELECT doc_id, source, source_order, k, fragment, n_chars, hi, hi - n_chars AS lo FROM s),
 w AS (SELECT DISTINCT sha256(text) AS fragment, lang AS k FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE quality = 1)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", "source", F.substring("source", 4, 9).cast("long").alias("source_order"), F.col("lang").alias("k"), F.sha2("text", 256).alias("fragment"), F.col("n_chars").alias("size"))
    return L.running_offsets(rows, ["source"], ["doc_id"]).withColumn("file", F.col("source")).withColumn("sha256", F.col("fragment"))


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").join(labels, "doc_id").select(F.sha2("text", 256).alias("fragment"), F.col("lang").alias("k")).distinct()


@query("q12_running_offsets", f"WITH {SPANS} SELECT doc_id, source, lo, hi FROM sp")
def q12(spark, sf):
    return spans(spark, sf).select("doc_id", "source", "lo", "hi")


@query("q13_contiguity_violations", f"WITH {SPANS}, g AS (SELECT *, lag(hi) OVER (PARTITION BY source ORDER BY lo, hi) AS expected FROM sp WHERE doc_id % 7 <> 3) SELECT doc_id, source, lo, expected FROM g WHERE expected IS NOT NULL AND lo <> expected")
def q13(spark, sf):
    return L.contiguity_violations(spans(spark, sf).where("doc_id % 7 <> 3"), ["source"]).select("doc_id", "source", "lo", "expected")


@query("q14_overlap_violations", f"WITH {SPANS}, m AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN greatest(lo - 5, 0) ELSE lo END AS lo, hi FROM sp), g AS (SELECT *, lag(hi) OVER (PARTITION BY source ORDER BY lo, hi) AS previous_hi FROM m) SELECT doc_id, source, lo, previous_hi FROM g WHERE lo < previous_hi")
def q14(spark, sf):
    moved = spans(spark, sf).withColumn("lo", F.when(F.col("doc_id") % 11 == 0, F.greatest(F.col("lo") - 5, F.lit(0))).otherwise(F.col("lo")))
    return L.overlap_violations(moved, ["source"]).select("doc_id", "source", "lo", "previous_hi")


@query("q15_fragment_digest", "SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS size FROM documents")
def q15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.file_digest(F.col("text")).alias("sha256"), F.length("text").cast("long").alias("size"))


@query("q16_group_digest", "SELECT source, sha256(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def q16(spark, sf):
    return D.group_digest(table(spark, sf, "documents"), ["source"], "doc_id", "text")


ROLLUP = "seg AS (SELECT CAST(l_linenumber AS BIGINT) AS k, CAST(l_suppkey % 10 AS BIGINT) AS layer, l_returnflag AS source, count(DISTINCT l_partkey % 64) AS experts FROM lineitem GROUP BY 1, 2, 3)"


@query("q17_tier_rollup", f"WITH {ROLLUP} SELECT k, count(DISTINCT layer) AS layers, min(layer) AS layer_lo, max(layer) AS layer_hi, count(*) AS segments, max(experts) AS max_experts, count(DISTINCT source) AS sources, max(layer) - min(layer) + 1 - count(DISTINCT layer) AS holes FROM seg GROUP BY 1")
def q17(spark, sf):
    li = table(spark, sf, "lineitem")
    seg = li.groupBy(F.col("l_linenumber").cast("long").alias("k"), (F.col("l_suppkey") % 10).cast("long").alias("layer"), F.col("l_returnflag").alias("source")).agg(F.countDistinct(F.col("l_partkey") % 64).alias("experts"))
    return L.tier_rollup(seg)


PLAN = f"{SPANS}, c AS (SELECT sp.*, row_number() OVER (PARTITION BY sp.fragment, sp.k ORDER BY source_order, lo) AS rn FROM w JOIN sp ON w.fragment = sp.fragment AND w.k = sp.k), pl AS (SELECT fragment, k, source, lo, hi, hi - lo AS size, CAST(sum(hi - lo) OVER (PARTITION BY source ORDER BY lo ROWS UNBOUNDED PRECEDING) AS BIGINT) - (hi - lo) AS local_off FROM c WHERE rn = 1)"


def plan(spark, sf):
    return P.fetch_plan(wanted(spark, sf), spans(spark, sf).drop("size"))


@query("q18_fetch_plan", f"WITH {PLAN} SELECT fragment, k, source, lo, hi, size, local_off FROM pl")
def q18(spark, sf):
    return plan(spark, sf).select("fragment", "k", "source", "lo", "hi", "size", "local_off")


@query(
    "q19_provider_override",
    f"WITH {CELLS}, c AS (SELECT DISTINCT layer, expert FROM e) SELECT layer, expert, CASE WHEN expert % 16 = 5 THEN 'p' || CAST(layer AS VARCHAR) WHEN layer % 3 = 1 THEN 'layer' ELSE 'default' END AS provider FROM c",
)
def q19(spark, sf):
    c = cells(spark, sf).select("layer", "expert").distinct()
    experts = c.where("expert % 16 = 5").withColumn("provider", F.concat(F.lit("p"), F.col("layer").cast("string")))
    layers = c.select("layer").distinct().where("layer % 3 = 1").withColumn("provider", F.lit("layer"))
    return P.override_provider(c, layers, experts, "default")


PREFER = f"{SPANS}, sl AS (SELECT fragment AS sha256, k || '-' || CAST(source_order AS VARCHAR) AS slot, source, doc_id, lo, hi FROM sp), pf AS (SELECT slot, min(sha256) AS wanted FROM sl WHERE doc_id % 5 = 0 GROUP BY 1), ch AS (SELECT sl.*, wanted, row_number() OVER (PARTITION BY sl.slot ORDER BY CASE WHEN sha256 = wanted THEN 0 ELSE 1 END, lo) AS rn FROM sl LEFT JOIN pf ON sl.slot = pf.slot)"


def slots(spark, sf):
    s = spans(spark, sf)
    return s.withColumn("fragment", F.concat_ws("-", "k", "source_order")).select("fragment", "k", "source", "source_order", "file", "lo", "hi", "sha256", "doc_id")


def slot_plan(spark, sf):
    s = slots(spark, sf)
    prefer = s.where("doc_id % 5 = 0").groupBy("fragment").agg(F.min("sha256").alias("sha256"))
    return P.fetch_plan(s.select("fragment", "k").distinct(), s, prefer), prefer


@query("q20_prefer_digest", f"WITH {PREFER} SELECT slot AS fragment, sha256, lo, coalesce(sha256 = wanted, false) AS preferred FROM ch WHERE rn = 1")
def q20(spark, sf):
    return slot_plan(spark, sf)[0].select("fragment", "sha256", "lo", "preferred")


@query("q21_unsatisfied_preferences", f"WITH {PREFER}, ask AS (SELECT slot, wanted FROM pf UNION ALL SELECT slot, sha256(slot) FROM pf WHERE slot LIKE 'en-%') SELECT a.slot AS fragment, a.wanted AS sha256 FROM ask a WHERE NOT EXISTS (SELECT 1 FROM ch WHERE rn = 1 AND ch.slot = a.slot AND ch.sha256 = a.wanted)")
def q21(spark, sf):
    chosen, prefer = slot_plan(spark, sf)
    ask = prefer.union(prefer.where("fragment like 'en-%'").select("fragment", F.sha2("fragment", 256)))
    return P.unsatisfied(ask, chosen).select("fragment", "sha256")


@query(
    "q22_plan_completeness",
    f"WITH {PLAN}, a AS (SELECT fragment, k, count(*) AS asked FROM w GROUP BY 1, 2), x AS (SELECT fragment, k FROM pl WHERE lo % 5 <> 0 UNION ALL SELECT fragment, k FROM pl WHERE lo % 7 = 0 UNION ALL SELECT DISTINCT fragment, k || '?' FROM sp WHERE doc_id < 4), b AS (SELECT fragment, k, count(*) AS planned FROM x GROUP BY 1, 2), f AS (SELECT coalesce(a.fragment, b.fragment) AS fragment, coalesce(a.k, b.k) AS k, coalesce(asked, 0) AS asked, coalesce(planned, 0) AS planned FROM a FULL JOIN b ON a.fragment = b.fragment AND a.k = b.k) SELECT fragment, k, asked, planned, CASE WHEN asked = 0 THEN 'unrequested' WHEN planned = 0 THEN 'missing' ELSE 'duplicate' END AS rule FROM f WHERE asked = 0 OR planned <> 1",
)
def q22(spark, sf):
    p = plan(spark, sf).select("fragment", "k", "lo")
    odd = spans(spark, sf).where("doc_id < 4").select("fragment", F.concat("k", F.lit("?")).alias("k")).distinct()
    broken = p.where("lo % 5 <> 0").select("fragment", "k").union(p.where("lo % 7 = 0").select("fragment", "k")).union(odd)
    return P.completeness_violations(wanted(spark, sf), broken, ["fragment", "k"])


def pieces(spark, sf):
    return plan(spark, sf).select("source", "lo", "hi")


@query("q23_coalesce_gap", f"WITH {PLAN}, m AS (SELECT source, lo, hi, CASE WHEN lo - lag(hi) OVER (PARTITION BY source ORDER BY lo, hi) BETWEEN 0 AND 3000 THEN 0 ELSE 1 END AS brk FROM pl), i AS (SELECT *, sum(brk) OVER (PARTITION BY source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT source, min(lo) AS start, max(hi) AS stop, count(*) AS n_pieces, CAST(sum(hi - lo) AS BIGINT) AS useful, CAST(max(hi) - min(lo) - sum(hi - lo) AS BIGINT) AS wasted FROM i GROUP BY source, island")
def q23(spark, sf):
    return P.coalesce_by_gap(pieces(spark, sf), ["source"], 3000)


def capped_sql(gap: int, cap: int) -> str:
    return f"""WITH RECURSIVE {PLAN}, o AS (SELECT source, lo, hi, row_number() OVER (PARTITION BY source ORDER BY lo, hi) AS n FROM pl),
 f AS (SELECT source, n, lo AS start, hi AS stop, 1 AS req FROM o WHERE n = 1 UNION ALL SELECT o.source, o.n, CASE WHEN o.lo - f.stop BETWEEN 0 AND {gap} AND o.hi - f.start <= {cap} THEN f.start ELSE o.lo END, o.hi,
  CASE WHEN o.lo - f.stop BETWEEN 0 AND {gap} AND o.hi - f.start <= {cap} THEN f.req ELSE f.req + 1 END FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
 SELECT f.source, min(o.lo) AS start, max(o.hi) AS stop, count(*) AS n_pieces, CAST(sum(o.hi - o.lo) AS BIGINT) AS useful, CAST(max(o.hi) - min(o.lo) - sum(o.hi - o.lo) AS BIGINT) AS wasted FROM f JOIN o ON f.source = o.source AND f.n = o.n GROUP BY f.source, f.req"""


@query("q24_coalesce_capped", capped_sql(3000, 20000))
def q24(spark, sf):
    return P.coalesce_capped(pieces(spark, sf), ["source"], 3000, 20000)


@query("q25_coalesce_adjacent", capped_sql(0, 50000))
def q25(spark, sf):
    return P.coalesce_adjacent(pieces(spark, sf), ["source"], 50000)


@query("q26_counterfactual_bytes", f"WITH {PLAN}, fl AS (SELECT source, k, CAST(sum(n_chars) AS BIGINT) AS size FROM sp GROUP BY 1, 2) SELECT (SELECT CAST(sum(hi - lo) AS BIGINT) FROM pl) AS ranged, (SELECT CAST(sum(size) AS BIGINT) FROM fl WHERE EXISTS (SELECT 1 FROM pl WHERE pl.source = fl.source AND pl.k = fl.k AND pl.lo % 2 = 0)) AS touched, (SELECT CAST(sum(size) AS BIGINT) FROM fl WHERE EXISTS (SELECT 1 FROM pl WHERE pl.source = fl.source)) AS tiers")
def q26(spark, sf):
    p, s = plan(spark, sf), spans(spark, sf)
    files = s.groupBy("source", F.concat_ws("/", "source", "k").alias("file"), F.lit(1).alias("k")).agg(F.sum("size").alias("size"))
    p = p.withColumn("file", F.concat_ws("/", "source", "k")).withColumn("k", F.lit(1))
    out = P.counterfactual(p, files)
    half = P.counterfactual(p.where("lo % 2 = 0"), files)
    return out.select("ranged", half.select("touched").scalar().alias("touched"), "tiers")


# -- releases and state --------------------------------------------------------------------------------------


def listing(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".safetensors").otherwise(".json")))
    return d.select("doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))


def snapshot(spark, sf):
    """A second snapshot: some files gone, some changed, some without digest, some new."""
    b = listing(spark, sf).where("doc_id % 10 <> 3")
    b = b.withColumn("sha256", F.when(F.col("doc_id") % 10 == 4, F.sha2("sha256", 256)).when(F.col("doc_id") % 10 != 5, F.col("sha256")))
    return b.withColumn("path", F.when(F.col("doc_id") % 10 == 6, F.concat("path", F.lit(".new"))).otherwise(F.col("path")))


LIST = "a AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'en' THEN '.safetensors' ELSE '.json' END AS path, sha256(text) AS sha, n_chars AS size FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 6 THEN path || '.new' ELSE path END AS path, CASE WHEN doc_id % 10 = 4 THEN sha256(sha) WHEN doc_id % 10 <> 5 THEN sha END AS sha, size FROM a WHERE doc_id % 10 <> 3), d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN coalesce(a.sha = b.sha AND a.size = b.size, false) THEN 'ok' ELSE 'bad' END AS status FROM a FULL JOIN b ON a.path = b.path)"


@query("q27_release_counts", f"WITH {LIST} SELECT count(*) AS files, count(*) FILTER (WHERE path LIKE '%.safetensors') AS fragments, CAST(sum(size) AS BIGINT) AS bytes FROM a")
def q27(spark, sf):
    return R.counts(listing(spark, sf))


@query("q28_release_diff", f"WITH {LIST} SELECT path, status FROM d")
def q28(spark, sf):
    return R.compare(listing(spark, sf), snapshot(spark, sf))


@query("q29_release_complete_verdict", f"WITH {LIST}, c AS (SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'bad') AS bad, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra FROM d) SELECT *, (ok > 0 AND bad = 0 AND missing = 0) AS lenient, (ok > 0 AND bad = 0 AND missing = 0 AND extra = 0) AS strict FROM c")
def q29(spark, sf):
    return R.verdict(R.compare(listing(spark, sf), snapshot(spark, sf)))


@query("q30_commit_plan", f"WITH {LIST}, r AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN sha END AS lfs, CASE WHEN doc_id % 3 = 0 THEN sha END AS remote_blob FROM b), f AS (SELECT coalesce(a.path, r.path) AS path, a.path AS ap, r.path AS rp, a.sha, lfs, remote_blob FROM a FULL JOIN r ON a.path = r.path) SELECT path, CASE WHEN ap IS NULL THEN 'delete' WHEN rp IS NULL THEN 'upload' WHEN CASE WHEN lfs IS NOT NULL THEN lfs = sha ELSE coalesce(remote_blob = sha, false) END THEN 'keep' ELSE 'upload' END AS action FROM f")
def q30(spark, sf):
    remote = snapshot(spark, sf).select("path", F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).alias("lfs"), F.when(F.col("doc_id") % 3 == 0, F.col("sha256")).alias("blob"))
    return R.commit_plan(listing(spark, sf).withColumn("blob", F.col("sha256")), remote)


@query("q31_resume_skip", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q31(spark, sf):
    return T.pending(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


STATE = "st AS (SELECT source AS source_fp, lang AS k, doc_id % 50 AS layer, doc_id AS written_at, sha256(text) AS sha256 FROM documents)"


@query("q32_state_upsert", f"WITH {STATE}, r AS (SELECT *, row_number() OVER (PARTITION BY k, layer ORDER BY written_at DESC) AS n FROM st) SELECT source_fp, k, layer, written_at, sha256 FROM r WHERE n = 1")
def q32(spark, sf):
    d = table(spark, sf, "documents")
    st = d.select(F.col("source").alias("source_fp"), F.col("lang").alias("k"), (F.col("doc_id") % 50).alias("layer"), F.col("doc_id").alias("written_at"), F.sha2("text", 256).alias("sha256"))
    return T.upsert(st.where("written_at % 3 <> 0"), st.where("written_at % 3 = 0"), ["k", "layer"])


@query("q33_provenance_drift", "SELECT doc_id, CASE WHEN doc_id % 9 = 2 OR doc_id % 9 = 4 THEN 'discard' WHEN doc_id % 9 = 5 THEN 'record' ELSE 'keep' END AS action FROM documents")
def q33(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("producer"))
    now = d.where("doc_id % 9 <> 4").withColumn("source", F.when(F.col("doc_id") % 9 == 2, F.concat("source", F.lit("x"))).otherwise(F.col("source"))).withColumn("producer", F.when(F.col("doc_id") % 9 != 5, F.col("producer")))
    return T.drift(d, now, ["doc_id"]).select("doc_id", "action")


@query("q34_digest_mismatch", f"WITH {LIST} SELECT a.doc_id, CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha = b.sha THEN 'ok' ELSE 'mismatch' END AS verdict FROM a LEFT JOIN b ON a.doc_id = b.doc_id")
def q34(spark, sf):
    rows = listing(spark, sf).select("doc_id", F.col("sha256").alias("want")).join(snapshot(spark, sf).select("doc_id", F.col("sha256").alias("got")), "doc_id", "left")
    return C.digest_verdicts(rows).select("doc_id", "verdict")


@query("q35_attestation_merge", f"WITH {SPANS}, l AS (SELECT source AS fragment, doc_id % 40 AS expert, CASE WHEN doc_id % 97 <> 0 THEN fragment END AS sha FROM sp), g AS (SELECT fragment, expert, min(sha) AS lo, max(sha) AS hi, count(*) AS lines, count(sha) AS seen FROM l GROUP BY 1, 2) SELECT fragment, expert, CASE WHEN seen = lines AND lo = hi THEN lo END AS sha256, lines, NOT (seen = lines AND coalesce(lo = hi, false)) AS rejected FROM g")
def q35(spark, sf):
    rows = spans(spark, sf).select(F.col("source").alias("fragment"), (F.col("doc_id") % 40).alias("expert"), F.when(F.col("doc_id") % 97 != 0, F.col("sha256")).alias("sha256"))
    return C.merge_attestations(rows)


@query("q36_unique_key_violations", "SELECT sha256(text) AS fingerprint, count(*) AS held FROM documents GROUP BY 1 HAVING count(*) > 1")
def q36(spark, sf):
    return C.unique_violations(table(spark, sf, "documents").select(F.sha2("text", 256).alias("fingerprint")), ["fingerprint"])


@query(
    "q37_coverage_partition",
    "WITH p AS (SELECT source, doc_id % 60 AS item FROM documents), wh AS (SELECT DISTINCT source, doc_id % 45 AS item FROM documents), a AS (SELECT source, item, count(*) AS held FROM p GROUP BY 1, 2), f AS (SELECT coalesce(a.source, wh.source) AS source, coalesce(held, 0) AS held, CASE WHEN wh.item IS NULL THEN 0 ELSE 1 END AS wanted FROM a FULL JOIN wh ON a.source = wh.source AND a.item = wh.item), g AS (SELECT source, count(*) FILTER (WHERE held = 0) AS missing, count(*) FILTER (WHERE held > 1) AS repeated, count(*) FILTER (WHERE wanted = 0) AS \"foreign\" FROM f GROUP BY 1) SELECT * FROM g WHERE missing + repeated + \"foreign\" > 0",
)
def q37(spark, sf):
    d = table(spark, sf, "documents")
    return C.partition_violations(d.select("source", (F.col("doc_id") % 60).alias("item")), d.select("source", (F.col("doc_id") % 45).alias("item")), ["source"], "item")


@query(
    "q38_cardinality_check",
    "WITH x AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS layer, CAST(l_partkey % 64 AS BIGINT) AS expert FROM lineitem WHERE NOT (l_suppkey % 10 = 3 AND l_partkey % 64 = 7) AND l_suppkey % 10 <> 8), g AS (SELECT layer, min(expert) AS lo, max(expert) AS hi, count(DISTINCT expert) AS n FROM x GROUP BY 1), p AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS layer, count(DISTINCT l_partkey % 64) AS asked FROM lineitem WHERE NOT (l_suppkey % 10 = 5 AND l_partkey % 64 = 63) GROUP BY 1), f AS (SELECT p.layer, CASE WHEN n IS NULL THEN 'no evidence' WHEN NOT (lo = 0 AND hi = n - 1) THEN 'not dense' WHEN asked <> n THEN 'policy length' END AS rule FROM p LEFT JOIN g ON p.layer = g.layer) SELECT layer, rule FROM f WHERE rule IS NOT NULL",
)
def q38(spark, sf):
    c = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).cast("long").alias("layer"), (F.col("l_partkey") % 64).cast("long").alias("expert"))
    return C.cardinality_violations(c.where("not (layer = 3 and expert = 7) and layer <> 8"), c.where("not (layer = 5 and expert = 63)"))


# -- vectors -------------------------------------------------------------------------------------------------

PAIRS = """v AS (SELECT vec_id, label, embedding FROM embeddings), fm AS (SELECT label, min(vec_id) AS vec_id FROM v GROUP BY 1), fv AS (SELECT v.label, v.vec_id, v.embedding FROM v JOIN fm ON v.vec_id = fm.vec_id),
 pr AS (SELECT v.vec_id, v.label AS label, f.label AS family, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS ab, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS aa, list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS bb FROM v JOIN fv f ON v.label < f.label OR v.label >= f.label)"""


def families(spark, sf):
    """Each vector against the first vector of each label."""
    e = table(spark, sf, "embeddings")
    heads = e.groupBy(F.col("label").alias("family")).agg(F.min_by("embedding", "vec_id").alias("head"))
    return M.against(e, ["vec_id", "label"], "embedding", heads)


@query("q39_pair_similarity", f"WITH {PAIRS} SELECT label, family, count(*) AS n, round(avg(ab / greatest(sqrt(aa) * sqrt(bb), 1e-30)), 6) AS cos_mean, round(least(1.0, min(ab / greatest(sqrt(aa) * sqrt(bb), 1e-30))), 6) AS cos_min FROM pr WHERE label < family GROUP BY 1, 2")
def q39(spark, sf):
    pairs = families(spark, sf).where("label < family")
    return M.similarity(pairs, ["label", "family"]).select("label", "family", "n", r6("cos_mean").alias("cos_mean"), r6("cos_min").alias("cos_min"))


@query("q40_rel_frobenius", f"WITH {PAIRS} SELECT label, family, round(avg(sqrt(greatest(aa + bb - 2 * ab, 0.0)) / greatest(sqrt(bb), 1e-30)), 5) AS rel_f_mean FROM pr WHERE label <> family GROUP BY 1, 2")
def q40(spark, sf):
    pairs = families(spark, sf).where("label <> family")
    return M.similarity(pairs, ["label", "family"]).select("label", "family", F.round("rel_f_mean", 5).alias("rel_f_mean"))


@query("q41_nearest_family", f"WITH {PAIRS}, r AS (SELECT vec_id, family, row_number() OVER (PARTITION BY vec_id ORDER BY round(ab / greatest(sqrt(aa) * sqrt(bb), 1e-30), 9) DESC, family) AS n FROM pr) SELECT vec_id, family FROM r WHERE n = 1")
def q41(spark, sf):
    f = families(spark, sf).withColumn("c", F.round("cosine", 9))
    return P.choose(f, ["vec_id"], [F.desc("c"), "family"]).select("vec_id", "family")


@query("q42_common_experts", "SELECT CAST(l_partkey % 64 AS BIGINT) AS expert FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 10) = (SELECT count(DISTINCT l_suppkey % 10) FROM lineitem)")
def q42(spark, sf):
    c = cells(spark, sf).select("layer", "expert").distinct()
    n = c.agg(F.countDistinct("layer")).scalar()
    return c.groupBy("expert").agg(F.count("*").alias("layers")).where(F.col("layers") == n).select("expert")


# -- documents, assembly, trust ------------------------------------------------------------------------------


@query("q43_content_dedupe", f"WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY source_order, doc_id) AS n FROM sp) SELECT fragment, source, doc_id FROM r WHERE n = 1")
def q43(spark, sf):
    return T.content_first(spans(spark, sf), "fragment", ["source_order", "doc_id"]).select("fragment", "source", "doc_id")


@query("q44_json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def q44(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"))


@query("q45_policy_explode", f"WITH {CELLS}, m AS (SELECT layer, expert, min(k) AS k FROM e GROUP BY 1, 2) SELECT layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS BIGINT) AS expert, k FROM m")
def q45(spark, sf):
    bits = S.tier_map(cells(spark, sf).groupBy("layer", "expert").agg(F.min("k").alias("k")))
    return bits.select("layer", F.posexplode("bits").alias("expert", "k")).withColumn("expert", F.col("expert").cast("long"))


@query("q46_dense_expand", f"WITH {CELLS}, x AS (SELECT DISTINCT layer, expert FROM e), sh AS (SELECT layer, k, CAST(sum(phi) AS BIGINT) AS rows FROM e GROUP BY 1, 2) SELECT x.layer, x.expert, sh.k, sh.rows FROM x JOIN sh ON x.layer = sh.layer")
def q46(spark, sf):
    c = cells(spark, sf)
    return S.expand_shared(c, c.groupBy("layer", "k").agg(F.sum("phi").alias("rows"))).select("layer", "expert", "k", "rows")


OVERRIDE = f"{SPANS}, o AS (SELECT doc_id, source, k, lo, hi, CASE WHEN doc_id % 4 = 1 THEN n_chars * 2 WHEN doc_id % 8 = 2 THEN NULL ELSE n_chars END AS sz, CASE WHEN doc_id % 4 = 1 THEN 'segment' WHEN doc_id % 8 = 2 THEN 'missing' ELSE 'source' END AS origin FROM sp)"


@query("q47_override_join", f"WITH {OVERRIDE} SELECT doc_id, source AS shard, origin, CAST(coalesce(sum(sz) OVER (PARTITION BY source ORDER BY lo, doc_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS new_hi FROM o")
def q47(spark, sf):
    s = spans(spark, sf).withColumn("layer", F.col("source_order")).withColumn("expert", F.col("doc_id"))
    src = s.select(F.col("source").alias("shard"), "layer", "expert", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "lo", "hi", "doc_id")
    pol = s.where("doc_id % 4 = 1 or doc_id % 8 = 2").select("layer", "expert", F.lit(4).alias("k"))
    seg = s.where("doc_id % 4 = 1").select("layer", "expert", F.lit(4).alias("k"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), (F.col("size") * 2).alias("size"), F.lit("I16").alias("dtype"))
    return S.override_join(src, pol, seg).select("doc_id", "shard", "origin", F.coalesce("new_hi", F.lit(0)).alias("new_hi"))


@query("q48_quota_sample", "WITH g AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM documents) SELECT doc_id, r.lang FROM r JOIN g ON r.lang = g.lang WHERE rk <= 50 // n + CASE WHEN place < 50 % n THEN 1 ELSE 0 END")
def q48(spark, sf):
    return V.quota_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 50, 42, "doc_id")


TRUST = "kf AS (SELECT sha256(CAST(n_nationkey AS VARCHAR)) AS fingerprint, n_name AS key_id, CASE n_regionkey WHEN 0 THEN 'revoked' WHEN 1 THEN 'retired' ELSE 'active' END AS status FROM nation), rq AS (SELECT n_nationkey AS request, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN sha256(CAST(n_nationkey AS VARCHAR)) WHEN 2 THEN substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 20) ELSE substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 8) END AS signer FROM nation)"


@query("q49_trust_decision", f"WITH {TRUST} SELECT CAST(request AS BIGINT) AS request, CASE WHEN request % 4 = 3 THEN 'short' WHEN status = 'revoked' THEN 'revoked' WHEN status = 'retired' THEN 'warned' ELSE 'trusted' END AS decision FROM rq JOIN kf ON kf.fingerprint = sha256(CAST(request AS VARCHAR))")
def q49(spark, sf):
    n = table(spark, sf, "nation")
    fp = F.sha2(F.col("n_nationkey").cast("string"), 256)
    status = F.when(F.col("n_regionkey") == 0, "revoked").when(F.col("n_regionkey") == 1, "retired").otherwise("active")
    keys = n.select(fp.alias("fingerprint"), F.col("n_name").alias("key_id"), status.alias("status"))
    kind = F.col("n_nationkey") % 4
    signer = F.when(kind == 0, F.col("n_name")).when(kind == 1, fp).when(kind == 2, F.substring(fp, 1, 20)).otherwise(F.substring(fp, 1, 8))
    return U.resolve(n.select(F.col("n_nationkey").cast("long").alias("request"), signer.alias("signer")), keys).select("request", "decision")


@query("q50_transport_totals", f"WITH {PLAN}, m AS (SELECT source, lo, hi, CASE WHEN lo - lag(hi) OVER (PARTITION BY source ORDER BY lo, hi) BETWEEN 0 AND 3000 THEN 0 ELSE 1 END AS brk FROM pl), i AS (SELECT *, sum(brk) OVER (PARTITION BY source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m), q AS (SELECT source, min(lo) AS start, max(hi) AS stop, sum(hi - lo) AS useful FROM i GROUP BY source, island) SELECT source, count(*) AS requests, CAST(sum(stop - start) AS BIGINT) AS bytes, CAST(sum(stop - start - useful) AS BIGINT) AS wasted FROM q GROUP BY 1")
def q50(spark, sf):
    return P.transport_totals(P.coalesce_by_gap(pieces(spark, sf), ["source"], 3000))


from fragmill.plans import catalog_checks, catalog_fetch  # noqa: E402,F401  (register their queries)
