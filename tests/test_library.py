"""Operators without a query in the catalogue, and the missing-evidence case of every verdict."""

import hashlib
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill.functions import crypto, digest, metrics, names
from fragmill.operators import allocate, assemble, checks, layout, plan, release, state, trust, verify
from fragmill.sources import documents, safetensors
from fragmill.sources.transport import PinnedRevision, ShortRead, Transport
from fragmill.streaming import evidence

SEED = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
KEY = "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- signatures ----------------------------------------------------------------------------------------------


def test_rfc8032_vectors():
    assert crypto.public_key(SEED).hex() == KEY
    s = crypto.sign(SEED, b"")
    assert s.hex().startswith("e5564300c360ac729086e2cc806e828a")
    assert crypto.verify(bytes.fromhex(KEY), b"", s)
    assert not crypto.verify(bytes.fromhex(KEY), b"x", s)
    assert not crypto.verify(bytes.fromhex(KEY), b"", s[:63])
    assert not crypto.verify(bytes.fromhex(KEY), b"", s[:32] + (int.from_bytes(s[32:], "little") + crypto.Q).to_bytes(32, "little"))


def envelope(body=None, **change):
    return json.dumps(crypto.sign_envelope(SEED, body or {"layer": 3, "k": 4, "expert_sha256": {"0": "a" * 64, "1": "b" * 64}}) | change)


def test_envelope_rules():
    good = envelope()
    assert crypto.check_envelope(good, KEY)[:2] == (True, "verified")
    cases = {
        "not JSON": "{",
        "not an object": "[]",
        "bad keyid": envelope(keyid="AB"),
        "untrusted key": envelope(keyid="0" * 64),
        "bad base64": envelope(signature="!!"),
        "signature length": envelope(signature="AAAA"),
        "bad signature": envelope(payload="e30="),
    }
    for reason, line in cases.items():
        assert crypto.check_envelope(line, KEY) == (False, reason, None)
    assert not crypto.check_envelope(good, None)[0] and not crypto.check_envelope(None, KEY)[0]


def test_verified_lines_and_attested_digests(spark):
    lines = [("f", "a", 0, envelope(keyid="0" * 64)), ("f", "a", 1, envelope()), ("f", "a", 2, envelope({"expert_sha256": {"1": "c" * 64, "2": "d" * 64}})), ("f", "b", 0, envelope()), ("f", "b", 1, envelope(payload="e30=")), ("g", "c", 0, envelope()), ("f", "d", 0, None)]
    df = spark.createDataFrame(lines, "family string, file string, line_no int, line string")
    v = trust.verify_lines(df, spark.createDataFrame([("f", KEY)], "family string, key string")).cache()
    assert {(r.file, r.line_no) for r in v.collect() if r.ok} == {("a", 1), ("a", 2), ("b", 0)}
    assert [(r.file, r.line_no) for r in trust.first_pinned(v).collect()] == [("a", 1)]
    got = rows(trust.attested_digests(v.where("file = 'a'")).select("expert", "sha256"))
    assert got == [(0, "a" * 64), (1, "b" * 64), (2, "d" * 64)]
    assert {r.reason: r.lines for r in trust.summary(v).collect()}["verified"] == 3


def test_trust_root_and_decisions(spark, tmp_path):
    fp = [c * 64 for c in "abcde"]
    p = tmp_path / "ROOT"
    p.write_text(f"# keys\n{fp[0]} one active 2026-01-01 publisher\n{fp[1]} two retired 2026-01-01 x # old\n{fp[2]} three revoked 2026-01-01 x\nbad line\n{fp[3]} four active 2026-01 x\n{fp[0]} five active 2026-01-01 x\n")
    keys = documents.trust_root(spark, str(p))
    assert keys.count() == 5
    files = spark.createDataFrame([(fp[0],), (fp[1],), (fp[4],)], "fingerprint string")
    rules = {r.rule for r in checks.trust_root_violations(keys, files).collect()}
    assert rules == {"added", "repeated fingerprint", "no key file", "unlisted key file"}
    asked = spark.createDataFrame([(1, "two"), (2, fp[2]), (3, fp[0][:8]), (4, "nobody"), (5, fp[3][:20]), (6, None), (7, fp[0])], "request int, signer string")
    assert dict(trust.resolve(asked, keys).select("request", "decision").collect()) == {1: "warned", 2: "revoked", 3: "short", 4: "unknown", 5: "trusted", 6: "unknown", 7: "ambiguous"}
    assert trust.rung(None, "r", "d") == ("root", "r") and trust.rung(None, None, None) == ("none", None)


# -- containers ----------------------------------------------------------------------------------------------


def container(path, n=3, change=None):
    raw = [hashlib.sha256(str(i).encode()).digest() * 2 for i in range(n)]
    tensors = [(f"model.layers.3.mlp.experts.{i}.gate_proj.rank0.trellis", "I16", [1, 1, 32], r) for i, r in enumerate(raw)]
    return raw, safetensors.write_container(str(path), tensors, {"layer": 3, "k": 2})


def test_round_trip_through_both_sources(spark, tmp_path):
    raw, made = container(tmp_path / "a.st")
    path = str(tmp_path / "a.st")
    h = safetensors.headers(spark, [path]).cache()
    assert hashlib.sha256(open(path, "rb").read()).hexdigest() == made["sha256"]
    got = h.orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in got] == [(0, 64), (64, 128), (128, 192)] and got[0].body_offset == made["body_offset"] and got[0].metadata["k"] == "2"
    assert got[0].header_sha256 == made["header_sha256"] and got[0].body_offset % 8 == 0
    req = [[path, r.body_offset + r.lo, r.body_offset + r.hi] for r in got]
    spans = safetensors.spans(spark, req).orderBy("start").collect()
    assert [bytes(s.content) for s in spans] == raw and [s.sha256 for s in spans] == list(made["tensors"].values())
    assert safetensors.spans(spark, req, content=False).where("content is not null").count() == 0
    keyed = names.with_tensor_key(h)
    assert [r.expert for r in names.canonical_order(keyed).collect()] == [0, 1, 2]
    assert {r.k for r in keyed.select(names.tier_of_shape(F.col("shape")).alias("k")).collect()} == {2}
    sized = h.withColumn("body_size", F.col("file_size") - F.col("body_offset"))
    assert layout.span_violations(sized).count() == 0


@pytest.mark.parametrize("raw", [b"", b"\x05\0\0\0\0\0\0\0{}", (1 << 27).to_bytes(8, "little") + b"{}", (2).to_bytes(8, "little") + b"[]", (2).to_bytes(8, "little") + b"{x", (13).to_bytes(8, "little") + b'{"a":1,"a":2}'])
def test_malformed_headers(raw):
    with pytest.raises(checks.SegmentIntegrityError):
        safetensors.parse_header(raw, len(raw))


def test_span_rules(spark):
    t = [("p", "a", "I16", [2, 2], 0, 8), ("p", "b", "F99", [1], 8, 12), ("p", "c", "U8", [-1], 8, 9), ("p", "d", "U8", [300], 8, 308), ("p", "e", "I32", [1], 8, 10), ("p", "f", "U8", [4], 6, 10), ("q", "g", "U8", [0], 3, 3), ("q", "h", "U8", [4], 0, 4), ("q", "i", "U8", None, 5, 6), ("q", "j", "U8", [1], None, None)]
    df = spark.createDataFrame(t, "path string, name string, dtype string, shape array<long>, lo long, hi long").withColumn("body_size", F.lit(100))
    got = {r.name: r.rule for r in layout.span_violations(df).collect()}
    assert got == {"b": "unknown dtype", "c": "bad shape", "d": "span outside body", "e": "span size", "f": "overlap", "g": "overlap", "i": "bad shape", "j": "span outside body"}


def test_segment_writer(spark, tmp_path):
    data = [(1, 2, f"t{i}", "U8", [4], bytes([i] * 4), i) for i in (2, 0, 1)] + [(2, 2, "u", "U8", [1], b"x", 0)]
    df = spark.createDataFrame(data, "layer int, k int, name string, dtype string, shape array<long>, content binary, ord int")
    got = safetensors.write_segments(df, str(tmp_path), ["layer", "k"], ["ord"], names.segment_name(F.col("layer"), F.col("k"))).collect()
    for r in got:
        raw = (tmp_path / r.file).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and len(raw) == r.size
    assert (tmp_path / "layer-001.k2.safetensors").read_bytes()[-12:] == b"\0\0\0\0\1\1\1\1\2\2\2\2"


def test_transport_retries_and_short_reads():
    calls, slept = [], []

    def fetch(url, start, stop):
        calls.append((start, stop))
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429 if len(calls) == 1 else 503, "", {"Retry-After": "7"} if len(calls) == 1 else {}, None)
        return b"x" * (stop - start), {}

    t = Transport(fetch=fetch, sleep=slept.append)
    assert t.get_range("http://h/f", 3, 8) == b"xxxxx" and slept == [7.0, 4] and t.stats() == {"requests": 1, "bytes": 5}
    with pytest.raises(ShortRead):
        Transport(fetch=lambda *a: (b"", {}), sleep=slept.append, retries=1).get_range("http://h/f", 0, 4)

    def gone(url, start, stop):
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    assert Transport(fetch=gone).small_file("http://h/f", missing_ok=True) is None
    with pytest.raises(urllib.error.HTTPError):
        Transport(fetch=gone).small_file("http://h/f")
    with pytest.raises(ValueError):
        PinnedRevision("A" * 40).observe("b" * 40)


# -- documents -----------------------------------------------------------------------------------------------


def test_loaders(spark, tmp_path):
    (tmp_path / "index-k3.json").write_text(json.dumps({"10": {"file": "f", "sha256": "s", "size": 9, "body_offset": 8, "experts": {"0": [0, 4], "1": [4, 9]}}}))
    assert rows(documents.index(spark, str(tmp_path / "index-k3.json")).select("layer", "k", "expert", "lo", "hi")) == [(10, 3, 0, 0, 4), (10, 3, 1, 4, 9)]
    (tmp_path / "p.json").write_text(json.dumps({"bits_per_expert": {"3": [3, 4], "4": [2]}}))
    assert rows(documents.policy(spark, str(tmp_path / "p.json"), [3])) == [(3, 0, 3), (3, 1, 4)]
    for bad in ({}, {"bits_per_expert": {"3": []}}, {"bits_per_expert": {"3": [True]}}, {"bits_per_expert": {"3": [17]}}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            documents.policy(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "s.txt").write_text("aa x\nbb  y\nonly\na b c\n")
    assert rows(documents.sums(spark, str(tmp_path / "s.txt"))) == [("aa", "x"), ("bb", "y")]
    (tmp_path / "l.jsonl").write_text(envelope() + "\n\n" + envelope() + "\n")
    assert [r.line_no for r in documents.attestations(spark, str(tmp_path / "l.jsonl")).orderBy("line_no").collect()] == [0, 2]
    (tmp_path / "e.json").write_text(json.dumps({"layer": 3, "bits": 4, "expert_rel_rt_mse": [0.5, 0.25], "expert_routed_count": [7, 9]}))
    assert rows(documents.eps(spark, str(tmp_path / "e.json"))) == [(4, 3, 0, 0.5, 7), (4, 3, 1, 0.25, 9)]
    (tmp_path / "r.json").write_text(json.dumps({"release": "v", "files": {"a": {"sha256": "x", "size": 1}}}))
    assert rows(documents.release(spark, str(tmp_path / "r.json"))) == [("v", "a", "x", 1)]
    (tmp_path / "m.json").write_text(json.dumps({"default": "d", "layers": {"3": "l"}, "experts": {"3": {"1": "e"}}}))
    assert documents.provider_map(spark, str(tmp_path / "m.json")).count() == 3
    assert "p.json" in {r.path for r in documents.tree(spark, str(tmp_path)).select("path").collect()}


def test_names_and_digests(spark):
    assert names.int_set("3-5, 12,,4") == [3, 4, 5, 12]
    df = spark.createDataFrame([("3-5, 12,,4", "ab", "2026-13-99T00:00:00Z")], "t string, b string, u string")
    r = df.select(names.int_set_column(F.col("t")).alias("s"), digest.git_blob(F.encode("b", "UTF-8")).alias("g"), names.is_utc(F.col("u")).alias("u"), names.human(F.lit(1500)).alias("h"), names.segment_name(F.lit(3), F.lit(4)).alias("n"), names.lenient_int(F.lit(" 7 ")).alias("i"), names.lenient_int(F.lit("true")).alias("j")).first()
    assert list(r.s) == [3, 4, 5, 12] and r.g == hashlib.sha1(b"blob 2\0ab").hexdigest() and r.u and r.h == "1.46 KB" and r.n == "layer-003.k4.safetensors" and r.i == 7 and r.j is None
    assert digest.canonical_json({"b": "é", "a": [1, None]}) == b'{"a":[1,null],"b":"\\u00e9"}'
    assert df.select(digest.canonical(F.lit('{"b":1, "a":2}')).alias("c"), digest.canonical(F.lit("{")).alias("d")).first()[:] == ('{"a":2,"b":1}', None)
    assert names.source_spec("o/r@main:a/b") == {"repo": "o/r", "revision": "main", "subdir": "a/b"}
    for bad in ("", "r@x:/a", "r@x:a/../b", "r@x:a//b"):
        with pytest.raises(ValueError):
            names.source_spec(bad)
    assert names.family_spec("x=/p,k=3+4") == {"label": "x", "path": "/p", "k": [3, 4]}
    assert names.locator("o/r", "A" * 40) == "o%2Fr@" + "a" * 40 + ":"
    with pytest.raises(ValueError):
        names.locator("o/r", "main")
    with pytest.raises(Exception, match="unknown projection"):
        names.with_tensor_key(spark.createDataFrame([("model.layers.1.mlp.experts.2.odd_proj.rank0.suh",)], "name string")).collect()


# -- checks: absence fails -----------------------------------------------------------------------------------


def test_missing_evidence_fails(spark):
    e = spark.createDataFrame([("a", None, None), ("b", "x", None), ("c", None, "x"), ("d", "x", "x"), ("e", "x", "y")], "id string, want string, got string")
    assert dict(checks.digest_verdicts(e).select("id", "verdict").collect()) == {"a": "missing", "b": "missing", "c": "missing", "d": "ok", "e": "mismatch"}
    assert checks.verdict_summary(checks.digest_verdicts(e)).first()[:] == (5, 1, 4)
    b = spark.createDataFrame([(1, "x", "x"), (2, None, None), (3, "x", None)], "i int, f string, want_f string")
    assert {r.i for r in checks.fragment_binding(b, ["f"]).where("binding_ok").collect()} == {1}
    nothing = spark.createDataFrame([], "path string, status string")
    assert release.verdict(nothing).first().lenient is False
    listed = spark.createDataFrame([("a", None, 1)], "path string, sha256 string, size long")
    assert release.compare(listed, listed).first().status == "bad"
    assert release.cross_check(listed, listed).first().fails
    with pytest.raises(checks.TrustError):
        checks.assert_clean(b, checks.TrustError)


def test_topology_and_layers(spark):
    t = [(3, e, "gate_proj", r, c, "I16" if c == "trellis" else "F16", [2, 4, 64] if c == "trellis" else [32] if c == "suh" else [64], 4) for e in range(2) for r in range(4) for c in ("trellis", "suh", "svh")]
    schema = "layer int, expert int, proj string, rank int, comp string, dtype string, shape array<long>, k int"
    good = spark.createDataFrame(t, schema)
    assert checks.topology_violations(good).count() == 0 and checks.scale_violations(good).count() == 0
    assert checks.topology_violations(good.where("not (expert = 1 and rank = 2)")).count() == 3
    assert checks.topology_differences(good, good).count() == 0
    assert checks.topology_differences(good, good.where("rank < 3")).count() == 6
    shared = spark.createDataFrame([], "layer int")
    a = checks.layer_analysis(good, shared).first()
    assert (a.signatures, a.tiers, a.shared_rows, a["layout"]) == (1, 1, 0, "per_expert_v1")
    tiers = spark.createDataFrame([(3, 0, 4), (3, 1, 3), (4, 0, 4), (5, 0, 4)], "layer int, expert int, k int")
    bitmap = spark.createDataFrame([(3, [4, 4]), (4, [4, 4])], "layer int, k array<int>")
    assert dict(checks.bitmap_agreement(tiers, bitmap).collect()) == {3: "MISMATCH(1 experts)", 4: "MISMATCH(len 1/2)", 5: "no-tier-bitmap"}
    ev = spark.createDataFrame([("rank_sliced", True), ("per_expert_v1", True)], "layout string, routed boolean")
    assert checks.effective_layout(ev).first()[0] == "rank_sliced"


def test_bindings_and_pins(spark):
    providers = spark.createDataFrame([("p", "a" * 40, "m"), ("q", "main", "m")], "provider string, revision string, manifest_sha256 string")
    b = spark.createDataFrame([("p", "m", "a" * 64), ("p", "z", "a" * 64), ("p", "m", "zz"), ("q", "m", "a" * 64), ("r", "m", "a" * 64), ("p", None, "a" * 64)], "provider string, manifest_sha256 string, sha256 string")
    assert sorted(r.rule for r in checks.binding_violations(b, providers).collect()) == ["digest", "manifest", "manifest", "no provider", "not pinned"]
    seg = spark.createDataFrame([(3, 3, "m"), (3, 4, "m"), (4, 3, "n"), (5, 3, None)], "layer int, k int, base_model string")
    assert {r.layer for r in checks.pinned_violations(seg, ["base_model"]).collect()} == {4, 5}


# -- plans, state, assembly ----------------------------------------------------------------------------------


def test_ranges_cost_less_than_files_and_drift(spark):
    spans = spark.createDataFrame([(f, "t", s, o, s, i * 10, i * 10 + 10, f"{f}{s}") for s, o in (("a", 0), ("b", 1)) for i, f in enumerate("xyz")], "fragment string, k string, source string, source_order int, file string, lo long, hi long, sha256 string")
    want = spark.createDataFrame([("x", "t"), ("z", "t")], "fragment string, k string")
    p = plan.fetch_plan(want, spans)
    assert rows(p.select("fragment", "source", "local_off")) == [("x", "a", 0), ("z", "a", 10)]
    q = plan.fetch_plan(want, spans, spark.createDataFrame([("z", "zb")], "fragment string, sha256 string"))
    assert rows(q.select("fragment", "source")) == [("x", "a"), ("z", "b")]
    assert plan.plan_drift(p, p).count() == 0 and plan.plan_drift(p, q).count() > 0
    files = spans.groupBy("source", "file", "k").agg(F.sum(F.col("hi") - F.col("lo")).alias("size"))
    c = plan.counterfactual(p, files).first()
    assert c.ranged < c.touched <= c.tiers
    assert plan.plan_digest(p, ["file"]).first().digest != plan.plan_digest(q.where("source='a'"), ["file"]).first().digest
    with pytest.raises(Exception, match="overlap"):
        plan.coalesce_adjacent(spark.createDataFrame([("f", 0, 5), ("f", 3, 8)], "f string, lo long, hi long"), ["f"], 100).collect()
    assert plan.template_conflicts(spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 2, "a"), (3, 2, None)], "layer int, k int, template string")).count() == 2


def test_state_rules(spark):
    s = spark.createDataFrame([("a", 3, 1, 5), ("b", 3, 1, 7)], "source_fp string, k int, layer int, written_at int")
    assert rows(state.upsert(s.where("written_at = 5"), s.where("written_at = 7"), ["k", "layer"])) == [("b", 3, 1, 7)]
    v1 = spark.createDataFrame([("layer-012.k3.safetensors",), ("other",)], "file string")
    assert rows(state.migrate(v1, "fp")) == [("fp", 3, 12, "layer-012.k3.safetensors")]
    cols = ["entry_sha", "entry_size", "file_sha", "file_size", "source", "want_source", "layout", "want_layout", "signed"]
    df = spark.createDataFrame([("x", 1, "x", 1, "s", "s", "l", "l", True), (None, 1, "x", 1, "s", "s", "l", "l", True), ("x", 1, "y", 1, "s", "s", "l", "l", True), ("x", 1, "x", 1, "s", None, "l", "l", True), ("x", 1, "x", 1, "s", "s", "l", "l", None)], "entry_sha string, entry_size int, file_sha string, file_size int, source string, want_source string, layout string, want_layout string, signed boolean")
    assert [r[0] for r in df.select(state.resumable({c: F.col(c) for c in cols})).collect()] == [None, "no entry", "digest", "other source", "not signed"]
    idx = spark.createDataFrame([(1, 3, 0, 0, 4, "s"), (1, 3, 1, 4, 8, "s"), (1, 4, 0, 0, None, "s")], "layer int, k int, expert int, lo long, hi long, sha256 string")
    assert state.index_for(idx, 3).first().experts == {0: [0, 4], 1: [4, 8]}
    with pytest.raises(Exception, match="corrupt"):
        state.index_for(idx, 4).collect()
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(3, "old"), (5, "old")], [(3, "new")]))
    assert rows(state.merge_manifest(a, b)) == [(3, "new"), (5, "old")]


def test_subset_equals_full_assembly(spark):
    src = spark.createDataFrame([("s", 1, e, f"t{e}", e * 4, e * 4 + 4) for e in range(4)] + [("s", None, None, "norm", 16, 18)], "shard string, layer int, expert int, name string, lo long, hi long")
    seg = spark.createDataFrame([(1, e, k, f"t{e}", 2 * k, "U8") for e in range(4) for k in (1, 2, 3)], "layer int, expert int, k int, name string, size long, dtype string")
    pol = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 1), (1, 3, 2)], "layer int, expert int, k int")
    full = assemble.override_join(src, pol, seg)
    subset = assemble.override_join(src, pol, seg.join(pol, ["layer", "expert", "k"], "left_semi"))
    assert rows(full.select("name", "new_lo", "new_hi")) == rows(subset.select("name", "new_lo", "new_hi"))
    assert assemble.needs_reindex(full).first()[1:] == (True, 0)
    assert assemble.needs_reindex(assemble.override_join(src, pol, seg.where("expert < 3"))).first().missing == 1
    assert layout.contiguity_violations(full.select("shard", "name", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")), ["shard"], 0).count() == 0
    assert [list(r.bits) for r in assemble.tier_map(pol).collect()] == [[2, 3, 1, 2]]


def test_staged_output(tmp_path):
    out = tmp_path / "out"
    with assemble.StagedOutput(str(out)) as d:
        open(f"{d}/a", "w").write("1")
    with pytest.raises(RuntimeError), assemble.StagedOutput(str(out), overwrite=True) as d:
        raise RuntimeError
    assert (out / "a").read_text() == "1"
    with pytest.raises(checks.AssemblyError), assemble.StagedOutput(str(out)):
        pass
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "x").touch()
    with pytest.raises(checks.AssemblyError), assemble.StagedOutput(str(tmp_path / "mine"), overwrite=True):
        pass
    for bad in ("/", str(tmp_path / "p" / "q")):
        with pytest.raises(checks.AssemblyError):
            assemble.check_destination(bad, [str(tmp_path / "p")])


def test_identity_proofs(spark):
    idx = spark.createDataFrame([(1, 3, 0), (1, 3, 1), (1, 3, 2)], "layer int, k int, expert int")
    att = spark.createDataFrame([(1, 3, 0, "a"), (1, 3, 1, "b")], "layer int, k int, expert int, sha256 string")
    got = spark.createDataFrame([(1, 3, 0, "a"), (1, 3, 1, "x"), (1, 3, 2, "c")], "layer int, k int, expert int, sha256 string")
    v = verify.identity_local(idx, att, got)
    assert rows(v.select("expert", "verdict")) == [(0, "ok"), (1, "mismatch"), (2, "missing")]
    assert json.loads(verify.report_json(v))["failures"] == 2 and "| identity.local | ok | 1 |" in verify.report_markdown(v)
    assert rows(verify.identity_fetched(got, att.union(att.where("expert = 0"))).select("expert", "verdict")) == [(0, "uncovered"), (1, "mismatch"), (2, "uncovered")]
    names_ = spark.createDataFrame([("t", "a"), ("u", "b")], "name string, sha256 string")
    assert rows(verify.identity_remote(names_, names_.where("name = 't'")).select("name", "verdict")) == [("t", "ok"), ("u", "missing")]
    ex = spark.createDataFrame([(1, 0, "g", 0, "suh", "s"), (1, 1, "g", 0, "suh", "o"), (1, 2, "g", 1, "suh", "s")], "layer int, expert int, proj string, rank int, comp string, sha256 string")
    par, prof = ex.where("expert = 1"), spark.createDataFrame([(1, "g", 0, "suh", "s")], "layer int, proj string, rank int, comp string, sha256 string")
    assert rows(verify.identity_derived(ex, par, prof).select("expert", "verdict")) == [(0, "ok"), (1, "ok"), (2, "missing")]
    assert verify.detect_check(False, True, False, False) == "identity.remote"
    assert verify.sample(got, "layer", 2, 7, "expert").count() == 2


def test_metrics(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    b = a + 0.05 * rng.normal(size=500)
    df = spark.createDataFrame([("same", a.tolist(), a.tolist()), ("near", a.tolist(), b.tolist())], "g string, a array<double>, b array<double>")
    got = {r.g: r for r in metrics.similarity(metrics.with_metrics(df, "a", "b"), ["g"]).collect()}
    assert abs(got["same"].cos_min - 1) < 1e-12 and got["same"].rel_f_max == 0 and got["same"].bitwise and not got["near"].bitwise
    assert abs(got["near"].rel_f_mean - np.linalg.norm(a - b) / np.linalg.norm(b)) < 1e-12
    raw = np.array([1.5, -2], "<f4")
    bf = (raw.view("<u4") >> 16).astype("<u2").tobytes()
    d = spark.createDataFrame([(bytearray(raw.tobytes()), bytearray(bf))], "a binary, b binary").select(metrics.decoder("F32")("a"), metrics.decoder("BF16")("b")).first()
    assert list(d[0]) == list(d[1]) == [1.5, -2.0]


def test_allocation_conserves_the_budget(spark):
    rng = np.random.default_rng(1)
    e = [(k, l, x, float(rng.random() / k), int(rng.integers(1, 50))) for k in (3, 4) for l in range(4) for x in range(8)]
    g = allocate.benefit(spark.createDataFrame(e, "k int, layer int, expert int, eps double, phi long"), 3, 4).cache()
    solved, even = allocate.upgrades_per_layer(g, 13), allocate.uniform_baseline(g, 13, 4, 8)
    assert solved.agg(F.sum("n_upper")).first()[0] == even.agg(F.sum("n_upper")).first()[0] == 13
    assert solved.agg(F.sum("captured")).first()[0] >= even.agg(F.sum("captured")).first()[0]
    flat = spark.createDataFrame([(0, x, 0.0) for x in range(4)], "layer int, expert int, benefit double")
    assert allocate.gini(flat).first().gini == 0.0
    assert allocate.budget_of(0.5, 9) == 4


def test_publish_retries():
    heads = iter(["a", "b", "c"])
    assert release.publish(lambda: next(heads), lambda h: h, lambda h, p: h == "b") == "b"
    with pytest.raises(RuntimeError):
        release.publish(lambda: "a", lambda h: h, lambda h, p: False, 2)


def test_stream_ingest(spark, tmp_path):
    src, st, ck = tmp_path / "in", str(tmp_path / "st"), str(tmp_path / "ck")
    src.mkdir()
    line = lambda fp, sha, t: json.dumps({"source_fp": fp, "k": 3, "layer": 1, "sha256": sha, "written_at": t}) + "\n"
    (src / "1.json").write_text(line("a", "x", "2026-01-01T00:00:00Z"))
    evidence.ingest(spark, str(src), st, ck).awaitTermination()
    (src / "2.json").write_text(line("b", "y", "2026-01-02T00:00:00Z"))
    evidence.ingest(spark, str(src), st, ck).awaitTermination()
    assert [(r.source_fp, r.sha256) for r in evidence.load_state(spark, st).collect()] == [("b", "y")]
