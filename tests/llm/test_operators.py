"""Operators against brute force, exact round trips, and small hostile inputs."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailpolicy.llm import chat, crowds, decontamination, licenses, packing, quality, queries, simhash, substring, tokens, topk, toxicity, wavelet
from mailpolicy.llm.common import crc_remainder, mixed, table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
HOSTILE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One."), (5, "one two"), (6, LONG), (7, LONG + " end"), (7, LONG + " end"), (8, "ÄÖé á 🙂 <|endoftext|> x"),
    (None, "a text without an id"), (9, "All rights reserved. Licensed under CC BY-NC 4.0 — GNU General Public License"), (10, "\x00\x01 \x1c..,,  !!"),
]
DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as results are."""
    df = spark.createDataFrame(HOSTILE, DOCS)
    for c in ("score", "row", "fp", "component_id", "h", "length", "n_words", "label", "task"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def ids_of(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_tokens_equal_those_of_whole_texts(name, cut, given):
    odd = ["a  b", "a \n b", " lead", "trail ", "it's 's x", "İ Σ ΑΣ βς ", "é a ́b", "<|endoftext|> a <|endoftext|>b", "a\r\n b", "a\x1c b \x85 c", "　 a", "\n\n\n a  ", "x" * 70 + " y", *(t for _, t in HOSTILE)]
    encoder, whole = tokens.Encoder(public_tokenizers.path(name), cut, most=500), ids_of(name)
    texts = odd + list(given.values())[:120] + odd
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text), text and text[:40]


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_plain_pieces_by_the_model_alone_equal_those_of_whole_texts(name, cut):
    encoder, whole = tokens.Encoder(public_tokenizers.path(name), cut), ids_of(name)
    parts = ["a", "Zebra", "İ", "Ⱥ", "é", "ß", "1", "²", ".", ",", "'", "'s", "!", "$$", "-", "\u0301", "日本", " ", " ", "\n", "\t", "\xa0", "\u2028", "<|endoftext|>"]
    texts = ["İ.", "Ⱥ! Ⱥ.", "word$$$\nWord## x\n$$", "naïve!! ÀÖØöø.", "3.14, a.b 1,,2", *("".join(p) for p in itertools.product(parts, repeat=3))]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text), text
    assert encoder.bare is not None and encoder.plain("Zebra$$" if cut == "dropped" else " Zebra$$")


# --- 1, 2: classifiers


def _auc(rows, truth):
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, t in held if t == c] for c in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])


@pytest.mark.parametrize("name, label, divisor, rest, least", [("op1_toxicity", "toxic", 4, 2, 0.8), ("op2_quality", "quality", 5, 0, 0.97)])
def test_classifiers_on_held_out_documents(spark, name, label, divisor, rest, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == rest) for r in rows)
    assert _auc(rows, {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}) > least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_hostile_tables(spark, hostile, empty, module, label):
    labels = table(spark, SF, "labels")
    known = table(spark, SF, "documents")
    found = module.scored(known.select("doc_id", "text").union(hostile.select(F.col("doc_id") + 10**6, "text")), labels, crc_remainder("doc_id", 4) != 2)
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert module.scored(empty, labels, F.lit(True)).count() == 0
    unlearned = module.scored(hostile, spark.createDataFrame([], f"doc_id long, {label} int"), F.lit(True)).collect()
    assert len(unlearned) == len(HOSTILE) and len({r.score for r in unlearned}) == 1
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (4, 1), (4, 0), (4, 1)], f"doc_id long, {label} int")
    assert module.scored(hostile, odd, F.lit(True)).count() == len(HOSTILE)


def test_the_score_ignores_other_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other = docs.withColumn("lang", F.lit("?")).withColumn("source", F.lit(None).cast("string"))
    a, b = (toxicity.scored(d, labels, F.lit(True)).orderBy("doc_id").collect() for d in (docs, other))
    assert a == b


# --- 3, 9: tokens


def _packed_well(rows, texts, size):
    whole = ids_of("word_bpe_49k.json")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in texts}
    for d, text in texts:
        ids = [*whole(text), 1]
        want = [(k, at, len(ids[at : at + size]), crc(ids[at : at + size])) for k, at in enumerate(range(0, len(ids), size))]
        got = Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
        assert set(want) <= set(got), d
    assert len(rows) == sum(-(-(len(whole(t)) + 1) // size) for _, t in texts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence), -(-sum(r.length for r in rows) // size)


def test_packing(spark, hostile, empty, given):
    sequences, bound = _packed_well(queries.op3_packing(spark, SF).collect(), list(given.items()), 4096)
    assert sequences <= bound * 1.03 + 1
    path = public_tokenizers.path("word_bpe_49k.json")
    _packed_well(packing.pack(hostile, path, "dropped", size=512).collect(), HOSTILE, 512)
    assert packing.pack(empty, path, "dropped").count() == 0


def test_packed_sequences_hold_the_documents(spark):
    docs = table(spark, SF, "documents")
    placed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "dropped", keep_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert crc(whole[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    h = {int(n): int(c) for n, c in zip(rng.integers(1, 257, 60), rng.integers(1, 10 ** (seed % 3 + 1), 60))}
    for least in packing.LEFT_OUT:
        runs, got = packing.packed(h, 256, least), Counter()
        for content, n in runs:
            assert sum(a * b for a, b in content) <= 256
            for a, b in content:
                got[a] += b * n
        assert got == h
    assert sum(n for _, n in packing.fewest(h, 256)) >= -(-sum(a * b for a, b in h.items()) // 256)


def test_nnls_finds_an_exact_fit():
    a = packing.patterns(12, 3)
    x = np.zeros(a.shape[1])
    x[[1, 5]] = 3, 2
    assert np.allclose(a @ packing.nnls(a, a @ x), a @ x)


def test_wavelet_files(spark, hostile, empty, given, tmp_path):
    whole = ids_of("byte_bpe_50k.json")
    start = 0
    for r in sorted(queries.op9_wavelet(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = [*whole(given[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = wavelet.round_trip(hostile, path, "kept", shard=1000).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(whole(t)) + 1, crc([*whole(t), 2])) for d, t in HOSTILE)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((d for d, _ in HOSTILE), key=lambda d: (d is not None, d or 0))
    assert wavelet.round_trip(empty, path, "kept").count() == 0


def test_pieces_are_remembered_between_writing_tasks():
    known = tokens.Encoder(ids_of.__globals__["public_tokenizers"].path("byte_bpe_50k.json"), "kept")
    texts = [" ".join(f"word{i} letters" for i in range(j, j + 40)) for j in range(0, 200, 40)]
    first = list(known.encode_all(texts))
    n = len(known)
    known.settle(n - 1)
    assert len(known) == n - 1 and list(known.encode_all(texts)) == first
    assert wavelet.REMEMBERED > tokens.FREQUENT


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (63, 9), (64, 2), (5000, 300), (5000, 70_000)])
def test_wavelet_answers(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    w, docs, counts, task, number = wavelet.from_file(wavelet.to_file(ids, [5, None], [n, 0], 3, 4))
    assert (w.ids() == ids).all() and docs == [5, None] and counts.tolist() == [n, 0] and (task, number) == (3, 4)
    for i in range(0, n, 97):
        assert w.access(i) == ids[i] and w.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        assert w.occurrences(int(ids[i])) == np.flatnonzero(ids == ids[i]).tolist()
    assert w.count(2**20) == 0
    with pytest.raises(IndexError):
        w.select(0, n)


# --- 4: licences


def _base(text):
    w, labels, places = words(text), set(), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, hostile, empty, given):
    rows = queries.op4_licenses(spark, SF).collect()
    assert len(rows) == len(given) and any(r.n_base for r in rows)
    for r in rows + licenses.license_scan(hostile.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        text = given[r.doc_id] if r in rows else dict(HOSTILE)[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert licenses.license_scan(empty).count() == 0


def test_license_phrases_overlap_and_tags():
    assert licenses.scan("CC by cc BY. all rights reserved all rights reserved")["n_base"] == 4
    assert licenses.scan("xcc by")["n_base"] == 0
    r = licenses.scan("# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\nmore")
    assert r["labels"] == "bsd-3-clause,gpl-2.0-only,mit" and r["score"] == 0.1


@pytest.mark.parametrize(
    "expression, order",
    [
        ("mit or gpl-2.0 and bsd", ["mit", "gpl-2.0", "bsd", "and", "or"]),
        ("(mit or gpl-2.0) and bsd", ["mit", "gpl-2.0", "or", "bsd", "and"]),
        ("gpl-2.0+ with x and mit", ["gpl-2.0+", "x", "with", "mit", "and"]),
        ("mit some prose", ["mit"]),
        ("mit and", ["mit"]),
        ("(mit or (isc", ["mit", "isc", "or"]),
        ("mit or (", ["mit"]),
        ("or mit", None),
        ("", None),
        (") mit", None),
    ],
)
def test_shunting_yard(expression, order):
    assert licenses.postfix(expression) == order
    if order:
        licenses.evaluated(order)


# --- 5: decontamination


def _leaks(docs, items):
    out = {}
    for d, text in docs.items():
        w, hit, named = words(text), set(), set()
        for item, t in items.items():
            b = words(t)
            n = min(10, len(b))
            panes = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in panes:
                    hit |= set(range(i, i + n))
                    named.add(str(item))
        out[d] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    return out


def _digests(found):
    return {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in found.collect()}


def test_decontamination_of_hostile_tables(spark, hostile, empty):
    items = {1: None, 2: "", 3: "One", 4: "two one two", 5: "a b c d e", 6: "q r s t u v w x y z 1 2 3", 7: "a a a a a a a a a a a a", 8: "q r s t u v w x y z 1 2 3", 9: "é É straße x y"}
    docs = {1: None, 2: "", 3: "one two one two", 4: "x a B c, d e f", 5: "k q r s t u v w x y z 1 2 3 k", 6: "a " * 40, 7: "q r s t u v w x y", 8: "é É straße x y", 9: "s t u v w x y z 1 2 3 zz a b c d", 10: "a b c d a b c d e"}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("doc_id", F.lit("x"))
    d = spark.createDataFrame(list(docs.items()), DOCS).withColumn("item_id", F.lit(0))
    assert _digests(decontamination.decontaminate(d, b)) == _leaks(docs, items)
    assert decontamination.decontaminate(hostile, b).count() == len(HOSTILE)
    assert decontamination.decontaminate(empty, b).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(d, spark.createDataFrame([], "item_id long, text string")).collect())


def test_decontamination_without_the_prefilter(spark, given, monkeypatch):
    monkeypatch.setattr(decontamination, "PREFILTER", -1)
    some = dict(list(given.items())[:60])
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    d = spark.createDataFrame(list(some.items()), DOCS)
    assert _digests(decontamination.decontaminate(d, table(spark, SF, "benchmark"))) == _leaks(some, items)


@pytest.mark.parametrize("seed", range(20))
def test_winnowing_keeps_a_common_gram(seed):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 4, 10, dtype=np.uint64)
    a, b = (np.r_[rng.integers(0, 4, rng.integers(0, 9), dtype=np.uint64), shared, rng.integers(0, 4, rng.integers(0, 9), dtype=np.uint64)] for _ in range(2))
    from mailpolicy.llm.common import gram_hashes

    at = [{tuple(x[p : p + 5]) for p in decontamination.winnowed(gram_hashes(x, 5), 6)} for x in (a, b)]
    assert at[0] & at[1]


# --- 6: chat


def test_chat_collapse(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c"), (4, 5, "user", "a"), (4, 7, "bot", "b"), (4, 9, "user", "c"),
        (5, 0, "user", "a"), (5, 1, "bot", "x"), (6, None, "user", None), (6, 0, None, "z"), (7, 0, "u", "sera"), (8, 0, "us", "era"), (9, 0, "q", "1"), (9, 0, "q", "1"), (9, 1, "q", "1"), (None, 0, "n", "n"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("p1", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat.rendered(turns).collect()}
    assert got == {3: (3, 2), 5: (2, 1), 6: (2, 1), 7: (1, 1), 8: (1, 1), 9: (2, 1), None: (1, 1)}
    texts = {r.conv_id: r.text for r in chat.rendered(turns).collect()}
    assert texts[5] == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nx<|im_end|>\n" and texts[6].startswith("<|im_start|>user\n<|im_end|>")
    assert chat.rendered(turns.limit(0)).count() == 0


def test_chat_rows_without_a_conversation(spark):
    """Each is a conversation of one turn: it falls to a longer one, counts with equal ones, and is a row of null id where there is no other."""
    rows = [(1, 0, "u", "a"), (1, 1, "b", "x"), (2, 3, "u", "c"), *[(None, t, "u", x) for t, x in ((0, "a"), (1, "c"), (9, "d"), (9, "d"), (None, "e"), (4, None))]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.n_turns, r.n_equal, r.text.count("<|im_start|>"), r.text.split("\n")[1]) for r in chat.rendered(turns).collect()), key=str)
    assert got == sorted([(1, 2, 1, 2, "a<|im_end|>"), (2, 1, 2, 1, "c<|im_end|>"), (None, 1, 2, 1, "d<|im_end|>"), (None, 1, 1, 1, "e<|im_end|>"), (None, 1, 1, 1, "<|im_end|>")], key=str)


def test_chat_runs_no_python(spark):
    plan = chat.rendered(table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 7: passages


def _passage(rng, n):
    return [f"p{x}" for x in rng.integers(0, 10**6, n)]


def test_passages_are_found_and_cut(spark, hostile, empty):
    rng = np.random.default_rng(1)
    shared, other, edited = _passage(rng, 60), _passage(rng, 55), _passage(rng, 120)
    changed = list(edited)
    changed[60] = "changed"
    text = {
        10: _passage(rng, 30) + shared + _passage(rng, 200), 11: _passage(rng, 90) + shared + _passage(rng, 5), 12: shared, 13: _passage(rng, 400), 14: _passage(rng, 300) + other, 15: other + _passage(rng, 10) + shared[:40],
        16: edited, 17: _passage(rng, 20) + changed + _passage(rng, 20), 18: ["the"] * 500, 19: ["the"] * 700 + _passage(rng, 9),
    }
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in text.items()], DOCS).union(hostile.filter("doc_id is null or doc_id < 10").select("doc_id", "text")).withColumn("n_chars", F.length("text")).withColumn("lo", F.lit(1))
    found = defaultdict(set)
    for r in substring.repeated_passages(docs).collect():
        assert r.keeper_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.first_word >= 50
        found[r.doc_id].add((r.keeper_id, r.first_word, r.end_word))
    assert {d for d in found if d > 9} == {11, 12, 15, 17, 19}
    assert (10, 90, 150) in found[11] and (10, 0, 60) in found[12] and (14, 0, 55) in found[15] and (16, 20, 140) in found[17]
    cut = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert 12 not in cut and set(text) - {12} <= set(cut) and {1, 2, 3} <= set(cut) and None in cut
    for d, w in text.items():
        if d not in found:
            assert cut[d].text == " ".join(w)
    assert cut[11].text.split() == text[11][:90] + text[11][150:] and cut[11].n_chars == len(cut[11].text)
    assert cut[15].text.split() == text[15][55:]
    assert substring.repeated_passages(empty).count() == 0 and substring.without_repeats(empty).count() == 0


@pytest.mark.parametrize("n, top, least", [(5, 9, 6), (6, 9, 6), (200, 10**9, 20), (200, 5, 20), (90, 2, 7)])
def test_compact_windows_cover_every_passage(n, top, least):
    h = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    c, first, last = substring.compact_windows(h, least)
    assert (last - first + 1 >= least).all() if len(c) else n < least
    for i in range(n - least + 1):
        for j in range(i + least - 1, n):
            covering = [k for k in range(len(c)) if first[k] <= i <= c[k] <= j <= last[k]]
            assert len(covering) == 1 and h[c[covering[0]]] == h[i : j + 1].min()


def test_longest_run_among_many_places():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 3, 50):
        a, b = (rng.integers(0, kinds, n).astype("<u4") for n in (150, 400))
        b[200:260] = a[40:100]
        runs = substring._Runs(a, b)
        for i in range(0, 150, 7):
            places = np.flatnonzero(b == a[i])
            if len(places):
                best = max((substring._common(a, b, i, j, 150), -j) for j in places.tolist())
                assert runs.longest(i, 150, places) == (best[0], -best[1])
    same = np.zeros(100_000, "<u4")
    assert substring._Runs(same, same).longest(0, 100_000, np.arange(100_000)) == (100_000, 0)


def test_passage_behind_many_copies_of_its_beginning(spark):
    """The passage begins with a line that the other text has forty times before it goes on."""
    line, rest = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 30), ("r", 28)))
    other = " ".join(f"o{i}" for i in range(90))
    texts = [(1, f"{(line + ' | ') * 40} {line} {rest} {other}"), (2, f"{' '.join(f'p{i}' for i in range(70))} {line} {rest}")]
    found = substring.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.keeper_id, r.first_word, r.end_word, r.keeper_first) for r in found] == [(2, 1, 70, 128, 1200)]


def test_exact_repeats_of_given_documents_are_found(spark, given):
    """Brute force: every pair of documents that share 46 shingles in a row is linked through common keepers."""
    found = queries.op7_substring(spark, SF).collect()
    linked = {(r.keeper_id, r.doc_id) for r in found}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    where = defaultdict(set)
    for d, text in given.items():
        w = words(text)
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(d)
    pairs = {tuple(sorted((a, b))) for s in where.values() for a in s for b in s if a != b}
    assert pairs and all(root(a) == root(b) for a, b in pairs)
    # Every repeated row of 50 words lies in a passage found, but for the one kept.
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.first_word, r.end_word))
    for d, text in given.items():
        w = words(text)
        for i in range(len(w) - 49):
            if min(where[tuple(w[i : i + 50])]) < d:
                covered = set().union(*(range(a, b) for a, b in spans[d]))
                assert set(range(i, i + 50)) <= covered


def test_repeats_in_a_crowd_that_shares_their_boilerplate(spark):
    """Pairs share 50 words each, 30 of which stand in all texts between other words."""
    rng = np.random.default_rng(5)
    boiler, texts = _passage(rng, 30), []
    for k in range(60):
        own = _passage(rng, 20)
        texts += [(d, " ".join(_passage(rng, 60) + own[:10] + boiler + own[10:] + _passage(rng, 60))) for d in (1000 + k, 2000 + (k * 7) % 60)]
    texts += [(d, " ".join(_passage(rng, 60) + boiler + _passage(rng, 60))) for d in (1, 2, 9998, 9999)]
    found = {(r.keeper_id, r.doc_id) for r in substring.repeated_passages(spark.createDataFrame(texts, DOCS)).collect() if r.first_word <= 60 and r.end_word >= 110}
    assert {(1000 + k, 2000 + (k * 7) % 60) for k in range(60)} <= found


def test_all_pairs_of_near_copies_are_linked(spark):
    """Each text has a word of its own in the same passage, so all are different; an equal text is a copy of the first one with it."""
    word = [f"b{i}" for i in range(220)]
    texts = [(i, " ".join([*(f"s{i}x{j}" for j in range(20)), *word[: 20 + 30 * i], f"own{i}", *word[21 + 30 * i :], *(f"e{i}x{j}" for j in range(20))])) for i in range(6)]
    texts.append((9, texts[4][1]))
    found = substring.repeated_passages(spark.createDataFrame(texts, DOCS)).collect()
    assert {(r.keeper_id, r.doc_id) for r in found} == {(i, j) for i in range(6) for j in range(i + 1, 6)} | {(4, 9)}
    assert [(r.first_word, r.end_word, r.similarity) for r in found if r.doc_id == 9] == [(0, 260, 1.0)]


@pytest.mark.parametrize("n, top, least", [(5, 9, 6), (6, 9, 6), (200, 10**9, 20), (200, 5, 20), (90, 2, 7)])
def test_hashes_of_rows_are_those_of_the_compact_windows(n, top, least):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    for f in range(2):
        salted = mixed(x + np.uint64((f + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        c, first, last = substring.compact_windows(salted, least)
        h = substring.window_hashes(x, least, f)
        assert set(h.tolist()) == {int(v) & ~15 | f for v in salted[c]} and len(h) == max(0, n - least + 1)


def test_what_is_left_out_has_no_passage():
    """Two texts that share only common tokens and have a passage are both mostly common; a text as a whole is alike enough, too."""
    found = 0
    for seed in range(300):
        rng = np.random.default_rng(seed)
        a, b = (rng.integers(1000, 1000 + rng.choice([40, 10**6]), 120).astype("<i4") for _ in "ab")
        common = np.arange(60, dtype="<i4")
        n = rng.integers(12, 60)
        for x in (a, b):
            at = rng.integers(0, 60)
            x[at : at + n] = common[:n]
            x[at + rng.integers(0, n, rng.integers(0, 8))] = rng.integers(10**7, 10**8)
        once = [np.unique(x, return_counts=True) for x in (a, b)]
        once = [many[np.searchsorted(kinds, x)] == 1 for x, (kinds, many) in zip((a, b), once)]
        if substring.passages(a.view("<u4"), b.view("<u4"), [(0, 119)], 20, 0.8):
            found += 1
            shared = np.intersect1d(a, b)
            assert all(substring.mostly_common(x, shared, np.empty(0, np.int64), 20, 0.8) == (True, True) for x in (a, b))
            assert substring._alike(a, np.unique(b), once[0], 20, 0.8) and substring._alike(b, np.unique(a), once[1], 20, 0.8)
    assert 50 < found < 250


def test_texts_that_share_one_line_are_not_paired(spark, monkeypatch):
    """A line of 30 words stands in all texts; pairs of them are not verified but for the one that shares more."""
    rng = np.random.default_rng(8)
    line, more = _passage(rng, 30), _passage(rng, 60)
    texts = [(i, " ".join([*_passage(rng, 80), *line, *(more if i in (7, 31) else ()), *_passage(rng, 40)])) for i in range(150)]
    made, keep = {}, substring.kept
    monkeypatch.setattr(substring, "kept", lambda df, name="table": made.setdefault(name, keep(df, name)))
    found = substring.repeated_passages(spark.createDataFrame(texts, DOCS)).collect()
    assert {(r.keeper_id, r.doc_id) for r in found} == {(7, 31)}
    assert made["standing"].count() > 150 and made["pairs"].count() < 1000


@pytest.mark.parametrize("kinds, changes, least", [(10**6, 12, 46), (10**6, 3, 20), (300, 25, 20), (30, 15, 12), (3, 5, 10)])
def test_passages_with_a_crowd_are_those_of_each_pair(kinds, changes, least):
    """Edited copies with repeated lines and moved parts, short and empty texts and one that is no copy."""
    found = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        one = rng.integers(0, kinds, 260).astype("<u4")
        one[150:180] = one[20:50]
        texts = [np.empty(0, "<u4"), one[: least - 1], one, rng.integers(0, kinds, 200).astype("<u4")]
        for _ in range(10):
            x = np.roll(one, rng.integers(0, 200)) if rng.random() < 0.3 else one.copy()
            x[rng.integers(0, 260, rng.integers(0, changes))] = rng.integers(0, 2 * kinds, 1)
            texts.append(np.delete(x[rng.integers(0, 60) :], rng.integers(0, 190, rng.integers(0, 6))))
        crowd = crowds.Crowd(texts)
        for i, y in enumerate(texts):
            others = [k for k in range(len(texts)) if k != i]
            mine = dict(crowd.passages(i, others, least, 0.8))
            for k, other in enumerate(others):
                expected = substring.passages(y, texts[other], [(0, len(y) - 1)], least, 0.8)
                found += len(expected)
                assert sorted(mine.get(k, [])) == sorted(expected)
    assert found > 100


def test_pairs_of_a_family_are_verified_together(tmp_path, monkeypatch):
    """No pair of 40 edited copies is compared by itself, but for two texts of one word."""
    rng = np.random.default_rng(4)
    one, texts = _passage(rng, 300), []
    for i in range(40):
        w = list(one)
        for at in rng.integers(0, 300, 8).tolist():
            w[at] = f"own{i}"
        texts.append(" ".join(w))
    texts += [" ".join(["the"] * n) for n in (1500, 1600)]
    folder = tmp_path.as_uri()
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array(texts)], names=["doc_id", "text"])
    places = {r["doc_id"]: r for b in substring._windows(iter([batch]), folder, 46, 4) for r in b.to_pylist()}
    pairs = [{"block": hi < 40, "lo": lo, "hi": hi} | {f"{s}_{c}": places[d][c] for s, d in (("lo", lo), ("hi", hi)) for c in ("file", "at", "size")} for hi in range(42) for lo in range(hi) if (hi < 40) == (lo < 40)]
    alone, passages = [], substring.passages
    monkeypatch.setattr(substring, "passages", lambda *a: alone.append(len(a[0])) or passages(*a))
    found = [r for b in substring._verify(iter([pa.RecordBatch.from_pylist(pairs)]), folder, pa.int64(), 46, 0.8) for r in b.to_pylist()]
    assert alone == [1596] and {(r["keeper_id"], r["doc_id"]) for r in found} == {(p["lo"], p["hi"]) for p in pairs}


def test_rows_of_a_class_do_not_count_again():
    """Common tokens in known rows make a text mostly common, but not alone; more common tokens around them do."""
    x = np.arange(200, dtype="<i4")
    known = substring._row_hashes(x.view("<u4"), 20).view(np.int64)[50:61]
    assert substring.mostly_common(x, x[50:80], known, 20, 0.8) == (True, False)
    assert substring.mostly_common(x, x[50:82], known, 20, 0.8) == (True, True)
    assert substring.mostly_common(x, x[50:65], known, 20, 0.8) == (False, False)


def test_near_copy_whose_middle_stands_earlier_too(spark):
    """A repeated line lies between two parts under 50 words; the keeper has it earlier, alike or with a longer run."""
    first, line, second = ([f"{c}{i}" for i in range(n)] for c, n in (("f", 45), ("l", 8), ("s", 45)))
    for early in (line, [*line, "y2", second[0]]):
        keeper = [*early, *(f"k{i}" for i in range(60)), *first, "x", *line, "y", *second]
        texts = [(1, " ".join(keeper)), (2, " ".join([*first, "x2", *line, "y2", *second]))]
        found = substring.repeated_passages(spark.createDataFrame(texts, DOCS)).collect()
        assert [(r.doc_id, r.keeper_id, r.first_word, r.end_word) for r in found] == [(2, 1, 0, 100)]


def test_equal_rows_are_never_lost():
    """Every row of ``least`` equal tokens lies in a passage, among few kinds of tokens and stray longer runs."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        a, b = (rng.integers(0, 4, n).astype("<u4") for n in (200, 300))
        for k in range(4):
            i, j = rng.integers(0, 170), rng.integers(0, 270)
            b[j : j + 25] = a[i : i + 25][: len(b[j : j + 25])]
        found = substring.passages(a, b, [(0, 199)], 20, 0.8)
        rows_b = {b[j : j + 20].tobytes() for j in range(281)}
        for i in range(181):
            assert a[i : i + 20].tobytes() not in rows_b or any(r[0] <= i and i + 19 <= r[1] for r in found)


def test_each_text_of_one_id_loses_its_own_repeats(spark):
    rng = np.random.default_rng(6)
    one, two = _passage(rng, 60), _passage(rng, 60)
    texts = [
        (1, one + _passage(rng, 9)), (2, two + _passage(rng, 9)), (5, _passage(rng, 70) + one + ["end5"]), (5, ["begin"] + two), (5, _passage(rng, 20)), (6, one[:55] + ["end6"]),
        (7, (same := _passage(rng, 90)) + ["a"]), (7, same + ["b"]), (8, None), (8, ["short"]),
    ]
    docs = spark.createDataFrame([(d, w and " ".join(w)) for d, w in texts], DOCS)
    expected = [(d, w and " ".join(w)) for d, w in texts]
    expected[2:4], expected[5] = [(5, " ".join(texts[2][1][:70] + ["end5"])), (5, "begin")], (6, "end6")
    assert sorted((r.doc_id, " ".join((r.text or "").split())) for r in substring.without_repeats(docs).collect()) == sorted((d, t or "") for d, t in expected)
    found = {(r.doc_id, r.keeper_id) for r in substring.repeated_passages(docs).collect()}
    assert found >= {(5, 1), (5, 2), (6, 1)} and all(d > k for d, k in found)


# --- 8: SimHash


def _print(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius):
    ids, parent = list(prints), {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_simhash_of_given_documents(spark, given):
    prints = {d: _print(t) for d, t in given.items()}
    want = _components(prints, 2)
    rows = queries.op8_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(set(want.values())) < len(want)


def test_simhash_of_hostile_tables(spark, hostile, empty):
    rows = simhash.near_duplicates(hostile).collect()
    assert len(rows) == len(HOSTILE)
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[3] == 1 and of[7] == of[6] == 6 and of[None] is None
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_of_planted_fingerprints(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    values = list({int(v) for v in base} | {int(v) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for v in base for _ in range(2)} | set(range(70)) | {(1 << 64) - 1 - x for x in range(9)})
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, fp long")
    got = [tuple(sorted(r)) for r in simhash.links(nodes, radius).collect()]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(3, 260), (259, 260), (1, 1)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == 100 for x in range(100, 141)) and all(got[x] == 3 for x in [7, 3, *range(200, 261)]) and got[1] == 1


# --- 10: search


def test_topk_of_hostile_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(450)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [1.0] * 6), (900, [0.0] * 6), (901, [1.0, 2.0]), (902, []), (100, rows[100][1]), (3, rows[3][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    monkeypatch.setattr(topk, "SCORES", 300)
    got = defaultdict(list)
    for r in topk.search(vectors, F.col("vec_id") % 100 == 0, block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    valid = [(i, [int(np.floor(1024 * np.float32(x).astype(float))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries_ = {i: v for i, v in valid if i % 100 == 0}
    assert set(got) == set(queries_)
    for q, v in queries_.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q)[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.search(vectors.limit(0), F.lit(True)).count() == 0
    assert topk.search(vectors, F.lit(False)).count() == 0
    assert topk.search(vectors.filter("vec_id in (100, 1, 2)").dropDuplicates(["vec_id"]), F.col("vec_id") == 100).count() == 2
