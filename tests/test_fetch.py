"""Fetching, priming and assembling with files, and what fails closed."""

import hashlib
import http.client
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from fragmill.functions import crypto, digest
from fragmill.functions.names import with_shared_key, with_tensor_key
from fragmill.operators import assemble, checks, fetch, prime, release
from fragmill.sources import documents, safetensors, transport

PROJ = ("gate_proj", "up_proj", "down_proj")


def source_tensors(layer=3, experts=2, shared=True):
    """A shard of two experts of tiers 3 and 4, in another order than the canonical one."""
    out = []
    for e in reversed(range(experts)):
        for p in PROJ:
            for r in range(4):
                k = 3 + e % 2
                raw = hashlib.sha256(f"{layer}{e}{p}{r}".encode()).digest()
                out.append((f"model.layers.{layer}.mlp.experts.{e}.{p}.rank{r}.trellis", "I16", [1, 1, 16 * k], (raw * k)[: 32 * k]))
                out.append((f"model.layers.{layer}.mlp.experts.{e}.{p}.rank{r}.suh", "F16", [16], raw))
                out.append((f"model.layers.{layer}.mlp.experts.{e}.{p}.rank{r}.mcg", "I32", [], raw[:4]))
    if shared:
        out += [(f"model.layers.{layer}.mlp.experts.shared_h.{p}.rank0.svh", "F16", [4], p.encode()[:8]) for p in PROJ]
    return out


def rows(spark, path):
    headers = safetensors.headers(spark, [path])
    own = with_tensor_key(headers)
    k = F.max(F.when(F.col("comp") == "trellis", (F.element_at("shape", -1) / 16).cast("int")))
    tiers = own.groupBy("layer", "expert").agg(k.alias("k"))
    return own.join(tiers, ["layer", "expert"]), with_shared_key(headers)


def test_prime_a_layer(spark, tmp_path):
    made = source_tensors()
    path = str(tmp_path / "model-layer-003.safetensors")
    safetensors.write_container(path, made)
    tensors, shared = rows(spark, path)
    out = tmp_path / "out"
    out.mkdir()
    told = {"repo": "o/r", "revision": "a" * 40, "file": os.path.basename(path), "base_model": "m", "file_sha256": None}
    got = prime.prime_layer(tensors, shared, [3, 4], told, safetensors.read_spans, str(out))
    files = {r.file: r for r in got["segments"].collect()}
    profile = got["profile"].collect()[0]
    assert set(files) == {"layer-003.k3.safetensors", "layer-003.k4.safetensors"}
    content = {n: raw for n, _, _, raw in made}
    for name, r in files.items():
        raw = (out / name).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and len(raw) == r["size"]
        table, meta, body = safetensors.parse_header(raw, len(raw))
        assert meta["shared_profile_sha256"] == profile.sha256 and meta["num_experts"] == "1" and "source_file_sha256" not in meta
        assert all(raw[body + t["data_offsets"][0] : body + t["data_offsets"][1]] == content[n] for n, t in table.items())
        ranked = [(PROJ.index(n.split(".")[6]), n.split(".")[7], ("trellis", "suh", "mcg").index(n.split(".")[8])) for n in sorted(table, key=lambda n: table[n]["data_offsets"])]
        assert ranked == sorted(ranked)
    broken = tensors.where("not (proj = 'up_proj' and rank = 2)")
    with pytest.raises(checks.SourceLayoutError):
        prime.prime_layer(broken, shared, [3], told, safetensors.read_spans, str(out))


def test_landing_resumes_and_refuses(spark, tmp_path):
    parts = [os.urandom(n) for n in (100, 1, 5000)]
    at = [0, 100, 101]
    table = {f"t{i}": {"dtype": "U8", "shape": [len(p)], "data_offsets": [a, a + len(p)]} for i, (p, a) in enumerate(zip(parts, at))}
    layouts = spark.createDataFrame([("x.safetensors", json.dumps(table), "{}")], "file string, tensors string, metadata string")
    sha = [hashlib.sha256(p).hexdigest() for p in parts]

    def pieces(content):
        return spark.createDataFrame([("x.safetensors", a, len(p), s, c) for a, p, s, c in zip(at, parts, sha, content)], "file string, local_off long, size long, sha256 string, content binary")

    with pytest.raises(Exception, match="not " + sha[1]):
        fetch.land(pieces([parts[0], b"?", parts[2]]), layouts, str(tmp_path)).collect()
    part = tmp_path / "x.safetensors.part"
    assert part.exists() and not (tmp_path / "x.safetensors").exists()
    got = fetch.land(pieces([None, parts[1], parts[2]]), layouts, str(tmp_path)).collect()[0]
    assert (got.written, got.kept) == (2, 1)
    raw = (tmp_path / "x.safetensors").read_bytes()
    assert hashlib.sha256(raw).hexdigest() == got.sha256 and raw.endswith(b"".join(parts))
    assert hashlib.sha256(raw[: got.body_offset]).hexdigest() == got.header_sha256
    with pytest.raises(Exception, match="not " + sha[0]):  # nothing is kept without its bytes
        fetch.land(pieces([None, parts[1], parts[2]]), layouts, str(tmp_path)).collect()


def test_assemble_writes_shards(spark, tmp_path):
    made = source_tensors(shared=False)
    path, segment = str(tmp_path / "model-layer-003.safetensors"), str(tmp_path / "seg.safetensors")
    safetensors.write_container(path, made)
    better = [(n, d, s, bytes(255 - b for b in raw)) for n, d, s, raw in made if ".experts.1." in n]
    safetensors.write_container(segment, better)
    src = with_tensor_key(safetensors.headers(spark, [path]))
    seg = with_tensor_key(safetensors.headers(spark, [segment])).withColumn("k", F.lit(4))
    policy = spark.createDataFrame([(3, 1, 4)], "layer int, expert int, k int")
    joined = assemble.override_join(src.withColumn("shard", F.lit("model-layer-003.safetensors")), policy, seg.withColumn("size", F.col("hi") - F.col("lo")))
    where = seg.select("name", F.col("path").alias("segment_path"), (F.col("body_offset") + F.col("lo")).alias("segment_lo"))
    joined = joined.withColumnsRenamed({"path": "source_path", "body_offset": "source_offset"}).join(where, "name", "left")
    out = tmp_path / "out"
    out.mkdir()
    got = assemble.write_shards(joined, safetensors.read_spans, str(out), {"format": "pt"}).collect()[0]
    raw = (out / "model-layer-003.safetensors").read_bytes()
    table, meta, body = safetensors.parse_header(raw, len(raw))
    assert meta == {"format": "pt"} and hashlib.sha256(raw).hexdigest() == got.sha256
    want = {n: r for n, _, _, r in made} | {n: r for n, _, _, r in better}
    assert {n: raw[body + t["data_offsets"][0] : body + t["data_offsets"][1]] for n, t in table.items()} == want
    with pytest.raises(Exception, match="missing tensor"):
        lacking = assemble.override_join(src.withColumn("shard", F.lit("s")), policy, seg.where("proj <> 'up_proj'").withColumn("size", F.col("hi") - F.col("lo")))
        lacking = lacking.withColumnsRenamed({"path": "source_path", "body_offset": "source_offset"}).join(where, "name", "left")
        assemble.write_shards(lacking, safetensors.read_spans, str(out)).collect()


def test_config_and_documents(tmp_path):
    config = {"tail": {"bits": 3.0}, "quantization_config": {"bits": 3.0}, "other": 1}
    mixed = assemble.synced_config(config, "mixed", [3, 4], "b.json:bits", "tail", {"codebook": "mcg"})
    assert mixed["tail"] == {"bits": "mixed", "k_values": [3, 4], "bits_per_expert": "b.json:bits"} and mixed["quantization_config"] == {"bits": "mixed", "codebook": "mcg"}
    assert assemble.synced_config(mixed, 4.0, None, "b.json:bits", "tail", {})["tail"] == {"bits": 4.0}
    assert assemble.synced_config({"x": 1}, 4.0, None, "", "tail", {}) == {"x": 1}
    assert "quantization_config" not in assemble.synced_config({"tail": {}}, 4.0, None, "", "tail", {"a": 1})
    path = str(tmp_path / "d.json")
    assert [fetch.write_if_changed(path, b"a"), fetch.write_if_changed(path, b"a"), fetch.write_if_changed(path, b"b")] == [True, False, True]
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub").mkdir()
    assert os.path.realpath(tmp_path) in assemble.protected_paths(str(tmp_path / "sub"), [])


def test_release_round_trip(spark):
    files = spark.createDataFrame([("a.safetensors", "a" * 64, 5), ("manifest.json", "b" * 64, 2)], "path string, sha256 string, size long")
    seed = bytes(range(32))
    envelope = release.sign_payload(release.build_payload(files, "s/1", "r", F.lit("2026-01-01T00:00:00Z")), seed)
    line = json.dumps(envelope)
    payload = release.verify_release(line, envelope["keyid"], "s/1")
    assert payload["counts"] == {"files": 2, "fragments": 1, "bytes": 7} and payload["manifest_sha256"] == "b" * 64 and "repo" not in payload
    for bad, key, schema in ((line, "0" * 64, "s/1"), (line, envelope["keyid"], "s/2"), (line.replace(envelope["payload"][:8], "AAAAAAAA"), envelope["keyid"], "s/1")):
        with pytest.raises(PermissionError):
            release.verify_release(bad, key, schema)


def test_untrusted_texts_do_not_raise(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert crypto.check_envelope(deep, "0" * 64)[0] is False
    seed = bytes(32)
    import base64

    for payload in (deep.encode(), '{"a": 1}'.encode("utf-16")):
        envelope = {"payload": base64.b64encode(payload).decode(), "signature": base64.b64encode(crypto.sign(seed, payload)).decode(), "keyid": crypto.public_key(seed).hex()}
        assert crypto.check_envelope(json.dumps(envelope), envelope["keyid"])[:2] == (False, "payload not JSON")
    df = spark.createDataFrame([(deep,)], "t string")
    assert df.select(digest.canonical(F.col("t")).alias("c")).first().c is None


@pytest.mark.parametrize("table", [{"t": 5}, {"t": {"dtype": "U8", "shape": [1]}}, {"t": {"dtype": "U8", "shape": [1], "data_offsets": [0]}}, {"t": {"dtype": "U8", "shape": [1], "data_offsets": [0, 99]}}, {"t": {"dtype": "U8", "shape": [-1], "data_offsets": [0, 1]}}, {"t": {"dtype": "U8", "shape": [True], "data_offsets": [0, 1]}}, {"__metadata__": []}])
def test_malformed_headers(table):
    head = json.dumps(table).encode()
    raw = struct.pack("<Q", len(head)) + head + b"x"
    with pytest.raises(checks.SegmentIntegrityError):
        safetensors.parse_header(raw, len(raw))


def test_transport_retries_and_pins():
    calls = []

    def fetch_(url, start, stop):
        calls.append(start)
        if len(calls) == 1:
            raise http.client.IncompleteRead(b"")
        if len(calls) == 2:
            raise ConnectionResetError
        return b"ab", {"x-repo-commit": "A" * 40}

    t = transport.Transport(fetch=fetch_, sleep=lambda s: None, pinned=transport.PinnedRevision("a" * 40))
    assert t.get_range("http://h/f", 0, 2) == b"ab" and len(calls) == 3
    with pytest.raises(transport.RevisionMoved):
        transport.Transport(fetch=fetch_, sleep=lambda s: None, pinned=transport.PinnedRevision("b" * 40)).get_range("http://h/f", 0, 2)
    assert transport.auth_headers("https://h/x", "https://h", "t", "u") == {"User-Agent": "u", "Authorization": "Bearer t"}
    assert "Authorization" not in transport.auth_headers("https://h.evil/x", "https://h", "t", "u")
    assert transport.resolve_url("https://h/", "o/r", "a b", "f") == "https://h/o/r/resolve/a%20b/f"


def test_header_scan_prunes_files(spark, tmp_path):
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"{i}.safetensors"))
        safetensors.write_container(paths[-1], [(f"t{i}", "U8", [1], b"x")])
    (tmp_path / "bad.safetensors").write_bytes(b"no")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = safetensors.headers(spark, [*paths, str(tmp_path / "bad.safetensors")])
        assert [r.name for r in df.where(F.col("path") == paths[1]).collect()] == ["t1"]
        assert sorted(r.name for r in df.where(F.col("path").isin(paths[:2])).collect()) == ["t0", "t1"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_loaders(spark, tmp_path):
    ok = {"fetch_binding": {"schema": "b/1", "providers": {"schema": "s/1"}, "content": {"manifests": {"p": "m"}, "experts": {"3": {"0": "d"}}}}}
    for name, doc in (("ok.json", ok), ("none.json", {"x": 1}), ("bad.json", {"fetch_binding": {"schema": "b/2"}})):
        (tmp_path / name).write_text(json.dumps(doc))
    got = documents.fetch_binding(spark, str(tmp_path / "ok.json"), "b/1", "s/1").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 0, None, "d"), (None, None, "p", "m")], key=str)
    assert documents.fetch_binding(spark, str(tmp_path / "none.json"), "b/1", "s/1").collect() == []
    with pytest.raises(Exception, match="bad fetch binding"):
        documents.fetch_binding(spark, str(tmp_path / "bad.json"), "b/1", "s/1").collect()
    side = tmp_path / "side"
    side.mkdir()
    (side / "config.json").write_text(json.dumps({"tail": {"tp": 4, "codebook": "mcg", "x": 1}}))
    (side / "tier_bitmap.json").write_text(json.dumps({"3": {"k": [3, 4]}}))
    r = documents.side_metadata(spark, str(side), "tail", ["tp", "codebook"]).first()
    assert r.config == {"tp": "4", "codebook": "mcg"} and r.bitmap["3"].k == [3, 4] and r.corpus_sha256 is None


def test_evidence_is_copied(spark, tmp_path):
    source, out = tmp_path / "s", tmp_path / "o"
    (source / "attestations").mkdir(parents=True)
    out.mkdir()
    (source / "attestations" / "layer-003.k4.jsonl").write_bytes(b"{}\n")
    pieces = spark.createDataFrame([(3, 4, 0, "s"), (3, 4, 1, "s"), (4, 4, 0, "s")], "layer int, k int, expert int, source string")
    locators = spark.createDataFrame([("s", "o%2Fr@x:")], "source string, locator string")
    covered = spark.createDataFrame([], "source string, layer int, k int, covered boolean")
    got = fetch.copy_files(fetch.evidence_copies(pieces, locators, covered), {"s": str(source)}, str(out)).collect()
    assert [(r.target, r["size"]) for r in got] == [("attestations/o%2Fr@x:/layer-003.k4.jsonl", 3)]
    assert (out / got[0].target).read_bytes() == b"{}\n"


def test_proofs_from_fresh_bytes(spark, tmp_path):
    import numpy as np

    from fragmill.functions import metrics
    from fragmill.operators import evidence, state, trust, verify

    a, b = np.arange(5, dtype="<f4"), np.array([1.5, -2], "<f2")
    path = str(tmp_path / "a.safetensors")
    made = safetensors.write_container(path, [("x", "F32", [5], a.tobytes()), ("y", "F16", [2], b.tobytes())])
    h = safetensors.headers(spark, [path])
    t = h.select("name", "dtype", "path", (F.col("body_offset") + F.col("lo")).alias("start"), (F.col("body_offset") + F.col("hi")).alias("stop"))
    assert {r.name: r["values"] for r in metrics.decoded(t, safetensors.read_spans).collect()} == {"x": a.tolist(), "y": b.tolist()}
    digests = lambda rq: safetensors.read_spans(rq, content=False)
    assert {r.name: r.sha256 for r in verify.fresh_digests(t, digests).collect()} == made["tensors"]
    pieces = spark.createDataFrame([("f", 0, path, 0, made["body_offset"]), ("f", 1, path, made["body_offset"], made["size"])], "file string, place int, path string, start long, stop long")
    assert verify.reassembled_digests(pieces, safetensors.read_spans).first().digest == made["sha256"]
    files = [("auto", made["header_sha256"], None, "digest"), ("auto", None, made["sha256"], "full"), ("digest", "0" * 64, made["sha256"], "refused"), ("full", None, "0" * 64, "refused"), ("unsafe", None, None, "unsafe")]
    for requested, attested, whole, want in files:
        df = spark.createDataFrame([(path, made["size"], made["body_offset"], requested, attested, whole)], "path string, size long, body_offset long, requested string, attested string, whole string")
        assert evidence.proven_headers(df, digests).first().method == want
    assert state.load_state(None, "s", True) == state.load_state("{", "s", False) == {"schema": "s", "files": {}}
    with pytest.raises(ValueError):
        state.load_state('{"schema": "t"}', "s", True)
    (tmp_path / "FINGERPRINTS").write_text("")
    assert trust.discover_root(None, None, ["/nowhere", str(tmp_path)]).endswith("FINGERPRINTS") and trust.discover_root(None, None, []) is None
    with pytest.raises(FileNotFoundError):
        trust.discover_root("/nowhere", None, [str(tmp_path)])
