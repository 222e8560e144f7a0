"""Each operator against its plain version, on a driver table and on awkward rows."""

import math
import random

import edge
import plain
import pytest

from tablarium.llm import anchors, chat, components, decontamination, licenses, packing, personal_data, quality_rules, repeats, secrets, simhash, substrings, trigrams
from tablarium.llm.common import read

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module", params=["driver", "edge"])
def docs(spark, request):
    return read(spark, SF, "documents") if request.param == "driver" else edge.table(spark)


@pytest.fixture(scope="module")
def texts(docs):
    return sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0]))


def named(texts):
    return [(k, t) for k, t in texts if k is not None]


def test_quality_rules(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, read(spark, SF, "labels")).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(t)
        assert not (r.kept and r.base_failed)


def test_quality_rules_find_planted_junk(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_secrets(docs, texts):
    got = {r.doc_id: r.base_sha256 for r in secrets.scan_secrets(docs).collect()}
    assert got == {k: plain.secrets(t) for k, t in texts}


def test_trigram_queries():
    assert trigrams.trigram_query("[0-9a-f]{24,}") is None
    assert trigrams.trigram_query("AKIA[A-Z0-9]{16,}") == {frozenset({"aki", "kia"})}
    assert trigrams.trigram_query("ab(c|d)e") == {frozenset({"abc", "bce"}), frozenset({"abd", "bde"})}
    assert trigrams.trigram_query("abc|x*") is None


def test_decontamination(spark, docs, texts):
    items = read(spark, SF, "benchmark").select("item_id", "text").union(spark.createDataFrame([(9001, "two words"), (9002, None), (9003, ""), (9004, "shared3 SHARED4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13")], "item_id long, text string"))
    want = plain.decontaminated(named(texts), [tuple(r) for r in items.collect()])
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.decontaminate(docs, items).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y z beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    found = lambda gap: {r.doc for r in decontamination.phrase_hits(docs, items, gap=gap).collect()}
    assert found(0) == {1} and found(1) == {1, 2} and found(3) == {1, 2, 3}


def in_order(rows):
    """Rows numbered by id, null ids last. Rows of one id go by a hash of their text; here these are alike or repeat nothing."""
    return list(enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))))


def same_repeats(got, rows, *how):
    """got: (doc_id, results) of all rows; copies under one id give the same results in any order."""
    want = plain.repeats([(n, t) for n, (_, t) in in_order(rows)], *how)
    ids = [k for _, (k, _) in in_order(rows)]
    assert sorted(((k, *want[n]) for n, k in enumerate(ids)), key=str) == sorted(got, key=str)


@pytest.mark.parametrize("few", [20_000, 1])
def test_byte_dedup(docs, texts, few, monkeypatch):
    monkeypatch.setattr(repeats, "FEW_KINDS", few)
    same_repeats([tuple(r) for r in substrings.byte_dedup(docs).collect()], texts, 100, bytes, lambda x: x if isinstance(x, bytes) else b"".join(x))


@pytest.mark.parametrize("few", [20_000, 1])
def test_word_dedup(docs, texts, few, monkeypatch):
    monkeypatch.setattr(repeats, "FEW_KINDS", few)
    want = plain.repeats([(n, t) for n, (_, t) in in_order(texts)], 20, bytes.split, b" ".join)
    ids = [k for _, (k, _) in in_order(texts)]
    assert sorted(((k, *[x for i, x in enumerate(want[n]) if i != 2]) for n, k in enumerate(ids)), key=str) == sorted((tuple(r) for r in substrings.word_dedup(docs).collect()), key=str)


@pytest.mark.parametrize("least", [20, 1])
def test_repeated_and_null_ids(spark, least, monkeypatch):
    """Copies under one id and under none are documents of their own; also where all grams count as common."""
    monkeypatch.setattr(anchors, "LEAST", least)
    passage = " ".join(f"p{k}" for k in range(45))
    rows = [(5, f"a {passage} b"), (5, f"a {passage} b"), (None, f"{passage} x"), (None, f"{passage} x"), (2, passage), (7, "alone"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same_repeats([tuple(r) for r in substrings.byte_dedup(docs).collect()], rows, 100, bytes, lambda x: x if isinstance(x, bytes) else b"".join(x))
    words = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.word_dedup(docs).collect()]
    assert sorted(words, key=str) == sorted([(2, 45, 0), (5, 47, 45), (5, 47, 47), (None, 46, 45), (None, 46, 46), (7, 1, 0), (7, 0, 0), (None, 0, 0)], key=str)


def test_simhash(docs, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_groups(docs).collect() if r.doc_id is not None}
    prints = {k: plain.simhash(t) for k, t in named(texts)}
    roots = plain.components(prints)
    assert got == {k: (prints[k], roots[k]) for k in prints}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_personal_data(docs, texts):
    got = {r.doc_id: r.base_sha256 for r in personal_data.find_personal_data(docs).collect()}
    assert got == {k: plain.personal(t) for k, t in texts}


def test_label_model_separates():
    model = personal_data.fit_label_model([((1, 1, 1, 1), 80), ((1, 1, 0, 1), 40), ((-1, -1, -1, -1), 60), ((1, -1, -1, -1), 20)])
    assert model.posterior((1, 1, 1, 1)) > 0.9 > 0.1 > model.posterior((-1, -1, -1, -1))


def test_planted_personal_data(spark):
    """Kinds beyond the base ones: planted numbers are found, look-alikes beside words against them aren't."""
    rng = random.Random(5)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    rows, want = [], {}
    for k in range(400):
        phone, ident, iban = f"{n(3)}-{n(3)}-{n(4)}", f"{1 + k % 6}{n(2)}-{n(2)}-{n(4)}", f"DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}"
        kind, value, good, bad = [("local_phone", phone, "call me, phone", "order"), ("id_number", ident, "my address and ssn", "part no"), ("account", iban, "account iban", "serial")][k % 3]
        wrong = {"local_phone": f"1{phone[1:]}", "id_number": f"000{ident[3:]}", "account": f"XX{iban[2:]}"}[kind]
        personal = k % 2 == 0
        before = f"text {k} says {good if personal else bad} "
        value = value if personal else wrong
        rows.append((k, f"{before}{value} and more"))
        if personal:
            want[k] = f"{kind}:{len(before)}:{len(before) + len(value)}"
    rows += [(1000 + k, f"mail me{k}@x.com") for k in range(50)]
    got = {r.doc_id: r.spans for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.spans and r.doc_id < 1000}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.9 * len(want) and right >= 0.9 * len(got)


def test_quality_rules_on_held_out_labels(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = quality_rules.quality_rules(docs, fit).join(held, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert len(rows) > 500 and sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(((k, *p) for k, t in texts for p in plain.pieces(t, tokenizer)), key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_plan_is_tight():
    assert sum(n for n, _ in packing.plan({6: 4, 4: 4, 5: 2, 3: 1, 7: 1}, 10)) == 6
    assert packing.fullest({3: 2, 5: 1, 4: 1}, 8) in ([(5, 1), (3, 1)], [(4, 1), (3, 1)])


def test_chat(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, None, "x"), (None, 0, "eve", "y")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 * 2 + 1 + 1
    ann = sorted((r.turn, r.segment, r.segment[r.mask_start : r.mask_end]) for r in got if r.perspective == "ann")
    assert ann[0] == (0, "<|system|>\nbe good<|end|>\n", "")
    assert ann[1] == (1, "<|assistant|>\nhi<|end|>\n", "hi<|end|>")
    assert ann[2] == ann[3] == (2, "<|user name=bob|>\n<|end|>\n", "")


def test_dialogues(spark):
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["system", "ann", "bob", "eve"]), "w" * rng.randrange(40)) for c in (1, 2, None) for k in range(150)] + [(3, None, "ann", "late"), (3, 0, "bob", "early"), (3, 0, "bob", "early"), (4, 1, "system", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(chat.dialogues(table, 500).collect(), key=lambda r: r.part):
        text, masks = got.setdefault((r.conv_id, r.perspective), ("", []))
        assert r.start == len(text) and (r.part == 0 or r.start >= 500 * r.part)
        got[r.conv_id, r.perspective] = text + r.text, masks + [m for m in r.masks.split(",") if m]
    want = {}
    for c in (1, 2, None, 3, 4):
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0))
        for view in {r[2] for r in turns} - {"system"}:
            text, masks = "", []
            for _, _, role, said in turns:
                head = "<|assistant|>\n" if role == view else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                if role == view:
                    masks.append(f"{len(text) + len(head)}:{len(text) + len(head) + len(said) + 7}")
                text += head + said + "<|end|>\n"
            want[c, view] = text, masks
    assert got == want


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nmore"), (2, "a/b/x.py", "code"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "c/y.py", "nothing"), (5, None, None), (6, "a/b/d/z.py", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/d/w.py", ""), (7, "a/b/d/w.py", ""),
    ]
    got = licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string"), "id", "path", "text").collect()
    assert len(got) == len(rows)
    assert {r.id: (r.license, r.origin) for r in got} == {
        1: ("MIT", "header"), 2: ("Apache-2.0", "directory"), 3: ("Apache-2.0", "header"), 4: (None, None), 5: (None, None), 6: ("GPL-3.0", "header"), 7: ("Apache-2.0", "directory"),
    }


def test_empty_tables(spark):
    none = edge.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        quality_rules.quality_rules(none, labels), secrets.scan_secrets(none), decontamination.decontaminate(none, items), substrings.byte_dedup(none),
        substrings.word_dedup(none), simhash.simhash_groups(none), personal_data.find_personal_data(none), packing.pack(none),
        licenses.license_scan(none, "doc_id", "source", "text"), chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.collect() == []
    assert not decontamination.decontaminate(edge.table(spark), items).filter("contaminated").count()
