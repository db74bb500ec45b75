"""Each operator against brute force on a small table of odd rows, and on an empty one."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clinspark.llm import bpe
from clinspark.llm.boosting import Boosting, isotonic
from clinspark.llm.language import codewords, fit_languages, identify, training_texts
from clinspark.llm.minhash import NearDuplicates, index_keys, keep_one, near_duplicates
from clinspark.llm.packing import Packing, pack
from clinspark.llm.quality import fit_quality, keep_good, score_quality, statistics
from clinspark.llm.records import DamagedRecord, RecordFormat, fetch, frame, read_index, read_shuffled, unframe, write_records
from clinspark.llm.search import SearchOptions, search
from clinspark.llm.text import table
from clinspark.llm.token_counts import Attribution, attribute, count_section_tokens
from clinspark.llm.toxicity import fit_toxicity, keep_clean, score_toxicity, training_labels
from clinspark.llm.warc import Salvage, WarcOptions, read_warc, record, digest, write_warc

from .conftest import ODD

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_matches_library(llm, odd, library):
    rows = bpe.decode(bpe.encode(odd, WORD), WORD).collect()
    have = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4")), r["decoded"]) for r in rows)
    want = Counter((i, tuple(x := ids_of(library, t)), library.decode(x, skip_special_tokens=False)) for i, t in ODD)
    assert have == want


def test_packing_covers_every_token_once(llm, odd, library):
    rows = pack(odd, Packing(WORD, 2, capacity=64)).collect()
    pieces, sequences = Counter(), {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and 0 < r["length"] <= 64
        pieces.update((int(t) for t in ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == Counter(int(i) for _, t in ODD for i in [*ids_of(library, t), 2])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(pieces.values()) // 64)


def test_records_round_trip_and_damage(llm, odd, library):
    folder = f"{llm.conf.get('spark.checkpoint.dir', None) or '/tmp'}/records-test-{np.random.default_rng().integers(1 << 60)}"
    manifest = write_records(odd, folder, RecordFormat(WORD, 2, shard_chars=2000))
    rows = fetch(read_index(manifest)).collect()
    have = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in rows)
    assert have == Counter((i, (*ids_of(library, t), 2)) for i, t in ODD)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in ordered][0] and [r["doc_id"] for r in ordered[1:]] == sorted(i for i, _ in ODD if i is not None)
    assert [r["start"] for r in ordered] == [0, *np.cumsum([len(r["ids"]) // 4 for r in ordered])[:-1].tolist()]
    shuffled = read_shuffled(manifest, 5)
    assert Counter(r["doc_id"] for r in shuffled.collect()) == Counter(i for i, _ in ODD)
    data = bytearray(frame(7, np.array([1, 70000], "<u4")))
    assert unframe(bytes(data))[0] == 7
    data[-6] ^= 1
    with pytest.raises(DamagedRecord):
        unframe(bytes(data))


def test_token_counts_match_whole_encoding(llm, odd):
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    rows = count_section_tokens(odd, Attribution(BYTE)).collect()
    have = Counter((r["doc_id"], r["char_start"], r["char_end"], r["n_tokens"], r["doc_tokens"]) for r in rows)
    want = Counter()
    for i, t in ODD:
        t = t or ""
        offsets, at = tokenizer.encode(t, add_special_tokens=False).offsets, 0
        for line in re.findall(r"[^\n]*\n|[^\n]+\Z", t) or [""]:
            want[(i, at, at + len(line), float(sum(at <= a < at + len(line) for a, _ in offsets)), len(offsets))] += 1
            at += len(line)
    assert have == want


def test_attribution_rules():
    start, end, low, high = (np.array(x) for x in ([0, 3, 6], [3, 6, 9], [0, 4, 8], [4, 7, 9]))
    assert attribute(start, end, low, high, "start").tolist() == [2, 1, 0]
    assert attribute(start, end, low, high, "majority").tolist() == [1, 2, 0]
    assert np.allclose(attribute(start, end, low, high, "fraction"), [4 / 3, 1, 1 / 3])


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1)))}
    found = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    found[a] = found[b] = min(found[a], found[b])
    return {i: (len(sets[i]), found[i]) for i in sets}


def test_near_duplicates_match_brute_force(llm, odd):
    rows = near_duplicates(odd, NearDuplicates(words=4)).collect()
    named = [(i, t) for i, t in ODD if i is not None and i != 9]
    want = brute_components(named, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] not in (None, 9)} == want
    assert len(rows) == len(ODD)
    nameless = [r for r in rows if r["doc_id"] is None]
    assert nameless[0]["component_id"] == 0 and not nameless[0]["kept"]


def test_chains_are_followed(llm):
    words = [f"w{k}" for k in range(60)]
    chain = [(k, " ".join(words[k:k + 40])) for k in range(12)]
    rows = near_duplicates(llm.createDataFrame(chain, "doc_id long, text string"), NearDuplicates(words=4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(chain, 4, 80)


def test_every_pair_within_the_distance_shares_a_key():
    options, rng = NearDuplicates(), np.random.default_rng(3)
    a = rng.integers(0, 65536, (300, 64)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(64, options.distance, replace=False)] ^= 1
    ka, kb = index_keys(a, options.chunks), index_keys(b, options.chunks)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


def test_keep_one_keeps_columns_and_one_of_repeated_rows(llm, odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(9) <= 1 and 0 in ids and 1 not in ids and None in ids and 3 in ids and 4 in ids


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_match_brute_force():
    texts = [t for _, t in ODD] + ["a b c d e f\na b c d e g\n\n \na b c d e f", "p q\np q\np q"]
    base, _ = statistics(pa.array(texts))
    assert list(zip(*(base[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [
        brute_statistics(t) for t in texts]


def test_quality_and_toxicity_learn_and_survive_odd_rows(llm, small_dir, odd, empty):
    small_dir = small_dir.replace("sf0.001", "sf0.01")
    documents, labels = table(llm, small_dir, "documents"), table(llm, small_dir, "labels")
    quality = fit_quality(documents, labels)
    rows = {r["doc_id"]: r for r in score_quality(documents, quality).collect()}
    known = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect()]
    assert np.mean([r["kept"] == bool(q) for q, r in known if not r["base_failed"]]) > 0.97
    toxicity = fit_toxicity(documents, training_labels(labels))
    scored = {r["doc_id"]: r for r in score_toxicity(documents, toxicity).collect()}
    held = [(r["toxic"], scored[r["doc_id"]]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for _, r in held)
    assert np.mean([r["predicted"] == t for t, r in held]) > 0.93 and not any(r["predicted"] for t, r in held if not t)
    for data, n in ((odd, len(ODD)), (empty, 0)):
        assert score_quality(data, quality).count() == score_toxicity(data, toxicity).count() == n
        assert keep_good(data, quality).columns == keep_clean(data, toxicity).columns == data.columns
    none = fit_toxicity(documents, labels.where("false"))
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(odd, none).collect())


def test_boosting_is_monotone_and_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = (x[:, 0] + 0.3 * rng.random(500) > 0.6).astype(float)
    trees = Boosting(trees=20, monotone={0: 1}).fit(x, y)
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.5)])
    assert (np.diff(trees.raw(line)) >= -1e-12).all() and trees.raw(line)[-1] > trees.raw(line)[0]
    at, level = isotonic(rng.random(300).round(1), (rng.random(300) > 0.5).astype(float))
    assert (np.diff(level) >= 0).all() and (np.diff(at) >= 0).all()


def test_language(llm, small_dir, odd, empty):
    documents = table(llm, small_dir.replace("sf0.001", "sf0.01"), "documents")
    model = fit_languages(training_texts(documents))
    rows = identify(documents, model).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97
    found = {r["doc_id"]: r for r in identify(odd, model).collect()}
    assert {i: found[i]["lang_pred"] for i in (3, 4, 5, 7)} == dict.fromkeys((3, 4, 5, 7), "und") and found[0]["lang_pred"] == "en"
    assert identify(empty, model).count() == 0
    assert identify(odd, fit_languages(empty)).where("lang_pred <> 'und'").count() == 0
    code = codewords(20)
    assert ((code[:, None] != code[None]).sum(axis=2) + 99 * np.eye(20)).min() >= 10


def test_search_matches_exhaustive_scores(llm, small_dir, empty):
    documents = table(llm, small_dir, "documents")
    queries = documents.where("doc_id % 50 = 0").selectExpr("doc_id query_id", "text")
    pruned = search(documents, queries, SearchOptions(k=3, shard_docs=60, block_docs=4)).collect()
    whole = search(documents, queries, SearchOptions(k=3, shard_docs=10**6, block_docs=10**6)).collect()
    assert sorted(map(tuple, pruned)) == sorted(map(tuple, whole)) and pruned
    assert search(empty, queries).count() == 0 and search(documents, queries.where("false")).count() == 0


def test_warc_roles_and_salvage(llm, tmp_path):
    pages = llm.createDataFrame(
        [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é"), (5, "u", "é")],
        "page_id long, url string, html string")
    rows = read_warc(write_warc(pages, f"{tmp_path}/w")).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows) == Counter([
        (1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 4),
        (5, "response", None, 2), (5, "response", None, 2)])
    assert {r["url"] for r in rows if r["page_id"] == 1} == {"http://a/ b\r\nX: y"}
    for compress in (True, False):
        options = WarcOptions(compress=compress)
        parts = [record(k, "u", f"page {k} ".encode() * 50, None, digest(f"page {k} ".encode() * 50), options) for k in range(4)]
        broken = bytearray(parts[1])
        broken[len(broken) // 2] ^= 0x55
        data = b"junk" + parts[0] + bytes(broken) + parts[2] + parts[3][:-20]
        path = tmp_path / f"damaged-{compress}.warc"
        path.write_bytes(data)
        found = list(Salvage(pa.OSFile(str(path)), len(data)).rows())
        assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 2]
        assert sum(r["size"] for r in found) == len(data)
        assert [r["at"] for r in found if r["kind"] == "gap"] == [0, 4 + len(parts[0]), len(data) - len(parts[3]) + 20]


def test_empty_tables(llm, empty, tmp_path):
    assert bpe.encode(empty, WORD).count() == pack(empty, Packing(WORD)).count() == near_duplicates(empty).count() == 0
    assert count_section_tokens(empty, Attribution(BYTE)).count() == 0
    assert fetch(read_index(write_records(empty, f"{tmp_path}/r", RecordFormat(WORD)))).count() == 0
    pages = empty.selectExpr("doc_id page_id", "text url", "text html")
    assert read_warc(write_warc(pages, f"{tmp_path}/e")).count() == 0
