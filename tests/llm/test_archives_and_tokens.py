"""WARC round trips, SentencePiece against the library, decontamination, the pipeline, SQL."""

import gzip
import hashlib
import os
import random
import resource
import time
from collections import Counter

import pytest
import sentencepiece as spm
from oracle import connect, duck_rows, spark_rows
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

import corpus_pipeline
from pairloom.llm import decontamination, queries, sentencepiece_codec, toxicity, warc
from pairloom.session import table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(connect(SF), queries.ORACLES[name])


# ---------------------------------------------------------------- archives


def files(root):
    return {f: hashlib.sha256(open(f"{root}/{f}", "rb").read()).hexdigest() for f in sorted(os.listdir(root))}


def test_archives_are_the_same_however_the_rows_are_split(spark, tmp_path):
    pages = table(spark, SF, "pages")
    made = []
    for n, parts in (("a", 1), ("b", 5)):
        warc.write_archives(pages.repartition(parts), f"file://{tmp_path}/{n}", shard_bytes=100_000, file_bytes=20_000)
        made.append(files(tmp_path / n))
    assert made[0] == made[1] and len(made[0]) > 10 and not any(f.startswith("_tmp") for f in made[0])
    back = {r.page_id: r.payload for r in warc.read_archives(spark, f"file://{tmp_path}/a").where("record_type = 'response'").collect()}
    want = {r.page_id: r.html for r in pages.collect()}
    assert all(want[k] == v for k, v in back.items()) and len(back) == len(set(want.values()))


def test_archives_are_plain_gzip_members_and_roll_by_compressed_size(spark, tmp_path):
    manifest = warc.write_archives(table(spark, SMALL, "pages"), f"file://{tmp_path}/w", file_bytes=30_000)
    for m in manifest:
        data = gzip.open(f"{tmp_path}/w/{m['file']}").read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.count(b"\r\nWARC-Type: re") == m["records"]
    assert all(m["bytes"] < 60_000 for m in manifest) and len(manifest) > 1


def test_damage_is_noticed(spark, tmp_path):
    m = warc.write_archives(table(spark, SMALL, "pages"), f"file://{tmp_path}/w")[0]
    path = f"{tmp_path}/w/{m['file']}"
    data = gzip.open(path).read().replace(b"<html", b"<hxml", 1)
    with gzip.open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="digest|record"):
        warc.read_archives(spark, f"file://{tmp_path}/w").collect()


def test_the_manifest_is_verified(spark, tmp_path):
    m = warc.write_archives(table(spark, SMALL, "pages"), f"file://{tmp_path}/w")[0]
    path = f"{tmp_path}/w/{m['file']}"
    data = open(path, "rb").read()
    with open(path, "wb") as f:  # whole records, but the last one is missing
        f.write(data[: data.rindex(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")])
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, f"file://{tmp_path}/w").collect()


def test_heavy_ids_and_null_ids_take_several_shards(spark, tmp_path):
    rows = [(i % 7 if i < 400 else None, "u", f"{i % 390} " * 60) for i in range(800)] + [(2**63 - 1, "u", "z" * 300), (-(2**63), "u", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", shard_bytes=5000)
    assert max(m["records"] for m in manifest) < 150 and sum(m["records"] for m in manifest) == 802
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h, []).append((i is None, i or 0))
    want = Counter((i, "response" if min(first[h]) == (i is None, i or 0) else "revisit") for i, _, h in set(rows))
    extra = len(rows) - len(set(rows))
    kinds = Counter((r.page_id, r.record_type) for r in got)
    assert sum((kinds - want).values()) == extra and not want - kinds
    digest = {hashlib.sha256(h.encode()).hexdigest(): min(v) for h, v in first.items()}
    assert all(r.refers_to == (None if digest[r.payload_digest][0] else digest[r.payload_digest][1]) for r in got if r.record_type == "revisit")


def test_edges_refine_heavy_ranges(spark):
    rows = [(i, "u", "x" * 50) for i in range(300)] + [(10**12 + i, "u", "x" * 50) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    edges = warc.shard_edges(pages, 1000)
    sizes = [0] * (len(edges) + 1)
    for i, _, _ in rows:
        sizes[sum(e <= i for e in edges)] += 50
    assert max(sizes) <= 1000 and min(sizes) > 0


# ---------------------------------------------------------------- tokens

TEXTS = ["", " ", "  a  b ", "▁x ▁", "日本 😀\n\t\x00a", "é" * 50, "<s> </s> <0x41>", "ﬁ Ａ㌔ é", "ガｶﾞ x　y", "①②½ ǅ ﷺ"]


def test_ids_spans_and_decoding_against_the_library(spark):
    codec = sentencepiece_codec.codec_at(sentencepiece_codec.default_model())
    lib = spm.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    for text in TEXTS + [r.text for r in table(spark, SMALL, "documents").collect()]:
        ids, start, end = codec.encode(text)
        assert ids.tolist() == lib.encode(text) and codec.decode(ids.tolist()) == lib.decode(ids.tolist())
        for p, a, z in zip(lib.encode(text, return_type="proto").pieces, start, end, strict=True):
            if not p.piece.startswith("<0x"):
                assert (p.begin, p.end) == (a, z)
        covered = b"".join(text.encode()[a:z] for a, z in zip(start, end, strict=True))
        assert covered == text.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisation_against_the_library(rule, squeeze):
    lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = pb.NormalizerSpec()
    spec.ParseFromString(lib.serialized_normalizer_spec())
    codec = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    codec.charmap, codec.squeeze, codec.dummy, codec.escape, codec.suffix = sentencepiece_codec.CharMap(spec.precompiled_charsmap), squeeze, True, True, False
    for text in TEXTS + ["The ﬃ Ⅷ  résumé ", "ｱｲｳ ｶﾞ"]:
        norm, align = codec.normalise(text)
        want, offsets = lib.Normalize(text, with_offsets=True)
        assert norm == want
        chars = [len(text[:i].encode()) for i in range(len(text) + 1)]
        at = [len(norm[:i].encode()) for i in range(len(norm) + 1)]
        assert [int(align[a]) for a in at] == [chars[o] for o in offsets]


def test_encode_and_decode_frames(spark, make_docs):
    docs = make_docs([(1, "Hello  world"), (2, None)])
    enc = sentencepiece_codec.encode_documents(docs)
    assert {r.doc_id: r.decoded for r in sentencepiece_codec.decode_ids(enc).collect()} == {1: "Hello  world", 2: ""}


# ---------------------------------------------------------------- decontamination


def test_exact_and_edited_passages(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    patterns = decontamination.Patterns(items)
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    found = {(i, k) for i, k, *_ in decontamination.search(texts, patterns)}
    assert found == {(i, k) for i, t in enumerate(texts) for k, y in items if y in t}
    rng = random.Random(1)
    for k, y in items:
        z = list(y)
        for _ in range(int(len(z) * 0.05)):
            at, kind = rng.randrange(len(z)), rng.random()
            z[at : at + 1] = ["x"] if kind < 0.4 else [] if kind < 0.7 else [z[at], "q"]
        assert k in {r[1] for r in decontamination.search(["before " + "".join(z).upper() + " after"], patterns)}


def test_edits_are_the_least_edit_distance():
    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(4)
    item = "".join(rng.choice("abcdefghijklmnop ") for _ in range(100))
    patterns = decontamination.Patterns([(1, item)])
    for n in range(0, 12):
        z = list(item)
        for at in sorted(rng.sample(range(100), n), reverse=True):
            z[at : at + 1] = rng.choice([[], ["Q"], [z[at], "Q"]])
        text = "start " + "".join(z) + " end"
        want = least(item.lower(), text.lower())
        got = decontamination.search([text], patterns)
        assert [r[2] for r in got] == ([want] if want <= 8 else [])


def test_no_match_spans_two_documents_and_blocks_agree(spark, make_docs, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from here"
    halves = [(1, item[:33]), (2, item[33:]), (3, "x " + item)]
    bench = spark.createDataFrame([(1, item)] + [(i, f"another item number {i} of some length {i * 7919}") for i in range(2, 30)], "item_id bigint, text string")
    one = sorted((r.doc_id, r.item_id) for r in decontamination.find(make_docs(halves), bench).collect())
    left = sorted(r.doc_id for r in decontamination.clean(make_docs(halves), bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    assert one == sorted((r.doc_id, r.item_id) for r in decontamination.find(make_docs(halves), bench).collect()) == [(3, 1)]
    assert left == sorted(r.doc_id for r in decontamination.clean(make_docs(halves), bench).collect()) == [1, 2]


def test_parts_of_items_at_any_offset(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    patterns, around = decontamination.Patterns(items), "prose that has nothing to do with the matter at hand stands here, "
    cuts = [(80, 220), (75, 225), (60, 180)] + [(a, a + 74) for a in range(0, 226, 7)]
    long = [(k, t) for k, t in items if len(t) >= 300]
    texts = [around + t[a:b] + " " + around for _, t in long for a, b in cuts]
    found = {i: k for i, k, *_ in decontamination.search(texts, patterns)}
    assert len(long) == 11 and [found.get(i) for i in range(len(texts))] == [k for k, _ in long for _ in cuts]
    mid = [(k, t) for k, t in items if 90 <= len(t) <= 120]
    assert mid and [r[1] for r in decontamination.search([around + t[8:82] + around for _, t in mid], patterns)] == [k for k, _ in mid]
    assert not decontamination.search([around * 9], patterns)


def test_runs_and_white_space_are_folded():
    item = "a question on\u2003rules " + "-" * 100 + "  and\n\n" + " " * 247 + "what stands behind them, in full"
    patterns = decontamination.Patterns([(1, item), (2, "rows " + "-=" * 100 + " end of the rows")])
    for text in (item.replace(" ", "\u2009"), "x " + item.upper() + " y", " ".join(item.split())):
        assert [r[1:3] for r in decontamination.search([text], patterns)] == [(1, 0)]
    started = time.perf_counter()
    assert decontamination.search([" " * 10_000_000, "-" * 10_000_000], patterns) == []
    assert [r[:3] for r in decontamination.search(["-=" * 20_000], patterns)] == [(0, 2, 0)]  # its parts are found
    assert time.perf_counter() - started < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3 << 20


def test_short_items_are_sought_verbatim(spark, make_docs):
    bench = spark.createDataFrame([(1, "What is it?"), (2, " what  IS it? "), (3, " \n"), (4, None)], "item_id bigint, text string")
    docs = make_docs([(1, "so: WHAT is\nit? yes"), (2, "somewhat is it?"), (3, "what is it"), (4, None)])
    assert sorted((r.doc_id, r.item_id, r.edits, r.match_end) for r in decontamination.find(docs, bench).collect()) == [(1, 1, 0, 15), (1, 2, 0, 15)]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [2, 3, 4]


def test_lots_change_nothing(spark, monkeypatch):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(300).collect()] + ["".join(t for _, t in items) * 3]
    want = decontamination.search(texts, decontamination.Patterns(items))
    monkeypatch.setattr(decontamination, "LOT", 50)
    assert decontamination.search(texts, decontamination.Patterns(items)) == want


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, sizes = docs.columns, [docs.count()]
    model = toxicity.train(docs, table(spark, SMALL, "labels"), ~toxicity.held_out())
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, SMALL).cache()
        rows = {r.doc_id: r for r in docs.collect()}
        sizes.append(len(rows))
        assert set(rows) <= set(before)
        if name == "sentencepiece":
            lib = spm.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
            assert all(list(r.ids) == lib.encode(before[i]) and r.n_tokens == len(r.ids) for i, r in rows.items())
            assert len(rows) == len(before)
        else:
            assert docs.columns == columns
            if name == "decontamination":
                items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
                assert set(before) - set(rows) == {i for i, t in before.items() if any(x in t for x in items)}
            if name == "near_dedup":
                from test_dedup import brute_components

                want = brute_components(sorted(before.items()), 5, 80)
                assert set(rows) == {c for _, c in want.values()}
            if name == "toxicity":
                scores = {r.doc_id: r.score for r in toxicity.score(table(spark, SMALL, "documents"), model, ("doc_id",)).collect()}
                assert set(rows) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert sizes[0] > sizes[-1] > 0.5 * sizes[0]


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.where(F.col("n_tokens") != F.size("ids")).count() == 0
