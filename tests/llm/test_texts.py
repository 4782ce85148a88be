"""Quality bands, pieces, languages, toxicity, licences, quotes and raking."""

import os
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.llm import hyperdim_lang, license_scan, raking, registry, toxic_lexicon
from strandlog.llm.compression_bands import base_counts, chunks_of, compression_bands
from strandlog.llm.quote_links import conversations_without_quotes, quote_links
from strandlog.llm.unigram_pieces import BYTE, MARKER, NORMAL, DoubleArray, Encoder, Pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab# \n\t\x1c é|", max_size=60))
def test_base_counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    assert base_counts(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_bands(spark):
    draw = random.Random(2)
    syllables = ["".join(draw.choices("abcdefghijklmnoprstuvw", k=2)) for _ in range(40)]
    prose = " ".join("".join(draw.choices(syllables, k=draw.randrange(1, 5))) for _ in range(900))
    noise = " ".join("".join(chr(draw.randrange(33, 127)) for _ in range(20)) for _ in range(500))
    docs = spark.createDataFrame([(1, prose), (2, "again and again it says " * 200), (3, noise), (4, "short")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["kept"] for r in compression_bands(docs).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_bands_judge_every_byte(spark):
    for n in range(1, 60):
        for size in range(1, n + 1):
            assert {k for at in chunks_of(n, size) for k in range(at, at + size)} == set(range(n))
    draw = random.Random(14)
    syllables = ["".join(draw.choices("abcdefghijklmnoprstuvw", k=2)) for _ in range(40)]
    prose = lambda n: " ".join("".join(draw.choices(syllables, k=draw.randrange(1, 5))) for _ in range(n))[:n]
    noise = lambda n: "".join(chr(draw.randrange(33, 127)) for _ in range(n))
    rows, good = [], set()
    for k, (n, m) in enumerate([(2048, 1900), (1200, 840), (650, 400), (8192, 4000)]):
        rows += [(10 * k, prose(n) + noise(m)), (10 * k + 1, noise(m) + prose(n)), (10 * k + 2, prose(n + m))]
        good.add(10 * k + 2)
    found = compression_bands(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found if r["kept"]} == good
    assert all(r["n_chunks"] for r in found)


TINY = Pieces([*(f"<0x{b:02X}>" for b in range(256)), MARKER, "a", "b", "ab", f"{MARKER}a", f"{MARKER}ab", "ba", "é", f"{MARKER}{MARKER}"], [0.0] * 256 + [-2.0, -3.0, -3.5, -4.0, -4.2, -5.0, -5.5, -6.0, -2.5], [BYTE] * 256 + [NORMAL] * 9)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é▁\n🙂", max_size=14))
def test_viterbi_and_round_trip(text):
    made = Encoder(TINY)
    assert made.decode(made.encode(text)) == text
    ids = {p: i for i, (p, k) in enumerate(zip(TINY.texts, TINY.kinds, strict=True)) if k == NORMAL}

    for word in made.words(f" {text}"):
        if word == MARKER:
            continue
        data = word.replace(" ", MARKER)

        @lru_cache(None)
        def best(at, data=data):
            if at == len(data):
                return 0.0
            found = [TINY.scores[ids[data[at:end]]] + best(end) for end in range(at + 1, len(data) + 1) if data[at:end] in ids]
            return max(found + ([] if data[at] in ids else [made.fallback + best(at + 1)]))

        assert abs(made.viterbi(word)[1] - best(0)) < 1e-9


def test_double_array():
    draw = random.Random(4)
    entries = {bytes(draw.choices(b"abcxyz\xc3\xa9", k=draw.randrange(1, 7))): k for k in range(2000)}
    trie = DoubleArray(entries)
    for _ in range(500):
        data = bytes(draw.choices(b"abcxyz\xc3\xa9", k=9))
        assert trie.prefixes(data, 2) == [(e, entries[data[2:e]]) for e in range(3, 10) if data[2:e] in entries]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no model file")
def test_model_file():
    made = Encoder(Pieces.from_file())
    assert [made.pieces.texts[i] for i in made.encode("Hello world")] == ["▁Hello", "▁world"]
    assert made.decode(made.encode(" odd  spaces\t\r\n▁ 🙂 \u0000")) == " odd  spaces\t\r\n▁ 🙂 \u0000"


def test_languages(spark):
    draw = random.Random(6)
    letters = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ü", "ent"], "cc": ["è", "oui", "ç"]}
    rows = [(k, " ".join("".join(draw.choices(letters[lang], k=3)) for _ in range(draw.randrange(3, 40))), lang) for k, lang in enumerate(draw.choices(list(letters), k=300))]
    rows += [(1000, "123 --", "aa"), (1001, None, "aa")]
    found = {r["doc_id"]: r for r in hyperdim_lang.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    held = [k for k in range(300) if found[k]["held_out"]]
    assert len(held) > 30 and sum(found[k]["lang_pred"] == rows[k][2] for k in held) >= 0.98 * len(held)
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_folding():
    assert toxic_lexicon.fold("L0SER p@thet1c ｓcum") == "loser pathetic scum"
    assert toxic_lexicon.fold("lоsеr") == "loser"  # Cyrillic letters
    assert toxic_lexicon.letter_runs("it's über-ok") == ["it", "s", "über", "ok"]


def test_matching_and_exceptions():
    lexicon = toxic_lexicon.Lexicon({"scum": 4.0, "vequ*": 3.0}, ["pond scum"])
    made = lexicon.matcher()
    assert lexicon.features("scum", made)[0] == 4.0 and lexicon.features("scumble discum", made)[0] == 0.0
    assert lexicon.features("vequoir!", made)[0] == 3.0 and lexicon.features("pond scum", made)[0] == 0.0
    assert lexicon.features("5CUM, and scum", made)[:2] == (8.0, 4.0) and lexicon.features("5CUM, and scum", made)[3] == 2
    assert lexicon.features("beyond scum", made)[0] == 4.0 and lexicon.features("pond scum, scum", made)[0] == 4.0
    assert lexicon.features("pond scum " * 20_000 + "scum", made)[3] == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd AB1. é", max_size=80), st.dictionaries(st.text(alphabet="abcd", min_size=3, max_size=5), st.sampled_from([1.0, 2.0, 3.5])), st.dictionaries(st.text(alphabet="abcd", min_size=3, max_size=4), st.sampled_from([1.5, 2.5])))
def test_automaton_finds_what_words_tell(text, words, beginnings):
    weights = words | {f"{p}*": w for p, w in beginnings.items()}
    lexicon = toxic_lexicon.Lexicon(weights)
    plain = toxic_lexicon.features_by_words(text, {e: {0: w} for e, w in weights.items()}, 1)
    assert list(lexicon.features(text, lexicon.matcher())[:3]) == pytest.approx(plain)


def brute_entries(texts, support, ratio, odds):
    """Entries and weights by plain counting, most outstanding first, relatives left out."""
    import math

    n = [sum(y == k for _, y in texts) for k in (0, 1)]
    found = {}
    for t, y in texts:
        for e in toxic_lexicon.entries_of(toxic_lexicon.letter_runs(toxic_lexicon.fold(t))):
            found.setdefault(e, [0, 0])[y] += 1
    ranked = []
    for e, (c, k) in found.items():
        weight = math.log((k + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        g = 2 * sum(v * math.log(v / ((c + k) * n[j] / sum(n))) for j, v in enumerate((c, k)) if v)
        if k >= support and weight >= odds and g >= ratio:
            ranked.append((-round(g, 9), -len(e), e, round(weight, 4)))
    taken = {}
    for _, _, e, weight in sorted(ranked):
        stem = e.rstrip("*")
        longer = any(o.rstrip("*").startswith(stem) for o in taken) and e != stem
        if not longer and not any(o.endswith("*") and stem.startswith(o[:-1]) and len(o) - 1 < len(stem) + (e == stem) for o in taken):
            taken[e] = weight
    return taken


def test_lexicon_against_brute_force():
    import numpy as np

    draw = random.Random(23)
    stems = ["grukh", "blarg", "mofe", "the", "of", "river"]
    texts = [(" ".join(draw.choice(stems[3 - 3 * y :]) + draw.choice(["", "a", "ok", "ix"]) for _ in range(12)), y) for y in draw.choices([0, 1], k=200)]
    counts = {}
    for t, y in texts:
        for e in toxic_lexicon.entries_of(toxic_lexicon.letter_runs(t)):
            counts.setdefault(e, [0, 0])[y] += 1
    entries = sorted(counts)
    n = [sum(y == k for _, y in texts) for k in (0, 1)]
    made = toxic_lexicon.chosen(entries, np.array([counts[e][1] for e in entries]), np.array([counts[e][0] for e in entries]), n[1], n[0], 8.0, 1.0)
    assert made == brute_entries(texts, 3, 8.0, 1.0) and made


def test_toxicity_learns(spark):
    draw = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        toxic = draw.random() < 0.3
        words = draw.choices(["the", "of", "and", "river", "stone", "light"], k=60) + (draw.choices(["grukh", "blarg"], k=2) if toxic else [])
        draw.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    found = toxic_lexicon.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and all(r["predicted"] == labels[r["doc_id"]][2] for r in held)


def licences(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}


def test_licences(spark):
    every = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    draw = random.Random(9)
    prose = [" ".join(draw.choices(["river", "stone", "the", "of", "light", "copyright", "permission", "terms"], k=30)) for _ in range(90)]
    rows = [(k, f"{p}\n{every[k] if k < len(every) else ''}\n{p}") for k, p in enumerate(prose)]
    found = licences(spark, rows)
    families = [f for f, ts in license_scan.TEMPLATES.items() for _ in ts]
    assert len(families) < 90 and [k for k, f in enumerate(families) if found[k]["families"] != f] == []
    assert all(found[k]["first_line"] == 2 for k in range(len(every)))
    assert all(found[k]["families"] == "" for k in range(len(every), 90))


def test_licences_in_parts_and_wrapped(spark):
    draw = random.Random(20)
    words = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.".split()
    wrapped = "\n".join([" ".join(words[:9]), " ".join(words[9:18]), " ".join(words[18:])])
    cases = [
        ("Text: CC BY 4.0", "cc-by", 2), ("available under a Creative Commons Attribution 4.0 International", "cc-by", 2), ("to deal in the Software without restriction", "mit", 2),
        (f"\n{wrapped}\n", "mit", 3), ("# SPDX-License-Identifier: MIT", "mit", 2), ("SPDX-License-Identifier: EUPL-1.2", "eupl", 2), ("Distributed under CC BY 4.0.", "cc-by", 2),
        ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "apache,mit", 2), ("of the river", "", None), ("the stone license of light", "", None),
    ]
    prose = [" ".join(draw.choices(["river", "stone", "the", "of", "light", "to", "any"], k=30)) for _ in range(200)]
    rows = [(k if k != 4 else None, f"{p}\n{cases[k][0] if k < len(cases) else ''}") for k, p in enumerate(prose)]
    found = licences(spark, rows + [(6, "no more"), (500, rows[0][1])])
    assert [(found[k if k != 4 else None]["families"], found[k if k != 4 else None]["first_line"]) for k in range(len(cases)) if k != 6] == [(f, n) for k, (_, f, n) in enumerate(cases) if k != 6]
    assert found[500]["families"] == "cc-by"


def brute_licences(made, text):
    """Every paragraph's best family, by plain loops over words."""
    notices = [(f, set(license_scan.ngrams_of(license_scan.words_of(t)))) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    at = {g: k for k, g in enumerate(made.vocabulary)}
    lines = text.split("\n")
    units, block = [(x, False) for x in lines if x.strip()], []
    for x in [*lines, ""]:
        if x.strip():
            block.append(x)
        else:
            units += [("\n".join(block), True)] if len(block) > 1 else []
            block = []
    plain, whole = [], []
    for unit, is_block in units:
        grams = license_scan.ngrams_of(license_scan.words_of(unit))
        hits = [at[g] for g in grams if g in at]
        if not hits:
            continue
        z = made.weights[hits].round(6).sum(axis=0) / len(hits) ** 0.5 + made.bias
        p = made.probabilities(z[None, :] / made.temperature)[0]
        name = made.classes[int(p.argmax())]
        share = max((len(gs & set(grams)) / min(len(gs), max(len(grams), 6)) for f, gs in notices if f == name), default=0)
        if name != license_scan.UNKNOWN and p.max() >= license_scan.LEAST_PROBABILITY and share >= license_scan.LEAST_COMMON:
            (whole if is_block else plain).append(name)
    return ",".join(sorted({*plain, *whole})), len(plain) + sum(f not in plain for f in whole)


def test_licences_against_brute_force(spark):
    draw = random.Random(21)
    every = [t.split() for ts in license_scan.TEMPLATES.values() for t in ts]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            of = draw.choice(every)
            a = draw.randrange(len(of))
            cut = [w for w in of[a : a + draw.randrange(1, 30)] if draw.random() < 0.9]
            parts.append(draw.choice(["", " "]).join([""]) + " ".join(draw.choices(["river", "the", "of", "light"], k=draw.randrange(6)) + cut))
        rows.append((k, draw.choice(["\n", "\n\n", " "]).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = license_scan.train(docs)
    found = {r["doc_id"]: (r["families"], r["n_paragraphs"]) for r in license_scan.license_scan(docs).collect()}
    assert found == {k: brute_licences(made, t) for k, t in rows}


def test_licence_classifier_is_fitted_on_all_lines(spark):
    draw = random.Random(31)
    every = [t.split() for ts in license_scan.TEMPLATES.values() for t in ts]
    common = "the of to and in is for this that with license".split()
    lines = [" ".join(draw.choices(["river", "stone", "light", *common[:-1]], k=draw.randrange(1, 40))) for _ in range(5000)]
    lines += [" ".join(draw.choices(common, k=draw.randrange(1, 9))) for _ in range(300)]
    for _ in range(600):
        of = draw.choice(every)
        a = draw.randrange(len(of))
        lines.append(" ".join(draw.choices(common, k=draw.randrange(4)) + of[a : a + draw.randrange(1, 30)]))
    lines += ["the copyright of stone"] * 31 + ["river permission"] * 15 + [f"conditions {k} " + "of light " * 300 for k in range(31)] + [" \t", "--", ""] * 9
    draw.shuffle(lines)
    docs = spark.createDataFrame([(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(len(lines) // 10 + 1)], "doc_id bigint, text string")
    made = license_scan.train(docs)

    notices = [set(license_scan.ngrams_of(license_scan.words_of(t))) for ts in license_scan.TEMPLATES.values() for t in ts]
    others = []
    for x in lines:
        grams = set(license_scan.ngrams_of(license_scan.words_of(x)))
        if x.strip() and all(len(grams & n) < license_scan.LEAST_COMMON * min(len(n), max(6, len(grams))) for n in notices):
            others.append((x, grams))
    assert 5500 < len(others) < 6000
    seen = Counter(w for _, gs in others for w in gs if " " not in w)
    marks = sorted({w for ts in license_scan.TEMPLATES.values() for t in ts for w in license_scan.words_of(t) if seen[w] <= license_scan.MARK_SHARE * len(others)})
    assert made.marks == marks and "permission" in marks and not {"copyright", "conditions"} & set(marks)
    vocabulary = sorted({g for n in notices for g in n if set(g.split()) & set(marks)})
    alike = Counter((tuple(sorted(gs & set(vocabulary))), zlib.crc32(x.encode()) % 5 == 0) for x, gs in others)
    texts, labels = [], []
    for family, ts in license_scan.TEMPLATES.items():
        for of in (t.split() for t in ts):
            windows = {" ".join(of[a : a + n]) for n in {6, max(4, len(of) // 2), len(of)} for a in range(len(of) - n + 1)}
            texts += sorted(windows)
            labels += [family] * len(windows)
    plain = license_scan.Classifier.fit(texts, labels, [(list(gs), h, n) for (gs, h), n in alike.items()], vocabulary, marks)
    assert made.vocabulary == vocabulary and made.temperature == plain.temperature
    assert abs(made.weights - plain.weights).max() < 1e-6 and abs(made.bias - plain.bias).max() < 1e-6


def test_licence_classifier_counts_lines_like_single_ones(monkeypatch):
    monkeypatch.setattr(license_scan, "TEMPLATES", {"a": ["one two three"], "b": ["four five"]})
    one, many = ["one two three", "four five"], ["a", "b"]
    vocabulary = ["four", "one", "one two", "two"]
    rows = [(["one"], False), ([], False), (["four"], True), ([], True)]
    times = [3, 7, 2, 5]
    single = license_scan.Classifier.fit(one, many, [(*r, 1) for r, n in zip(rows, times, strict=True) for _ in range(n)], vocabulary, [], steps=50)
    counted = license_scan.Classifier.fit(one, many, [(*r, n) for r, n in zip(rows, times, strict=True)], vocabulary, [], steps=50)
    assert single.temperature == counted.temperature and abs(single.weights - counted.weights).max() < 1e-9 and abs(single.bias - counted.bias).max() < 1e-9


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello my dear friend there"), (1, 1, "a", "> Hello my dear friend there\n\nI answer you with this"),
        (1, 2, "u", ">> Hello, my DEAR friend there\n> I answer you with this\nthird says so"), (1, 3, "u", "nothing quoted at all"),
        (2, 0, "u", "> third says so\nelsewhere"), (2, 1, "u", "> never written anywhere else\nhm"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {(r["conv_id"], r["turn"]): r for r in quote_links(df).collect()}
    link = {k: (r["parent_conv"], r["parent_turn"], r["root_turn"], r["depth"]) for k, r in found.items()}
    assert link == {(1, 0): (None, None, 0, 0), (1, 1): (1, 0, 0, 1), (1, 2): (1, 1, 0, 2), (1, 3): (None, None, 3, 0), (2, 0): (1, 2, 0, 0), (2, 1): (None, None, 1, 0)}
    assert found[1, 2]["text"] == "third says so" and found[1, 2]["n_quotes"] == 2 and found[2, 1]["n_linked"] == 0
    assert [r["turn"] for r in conversations_without_quotes(df).where("conv_id = 1").orderBy("place").collect()] == [0, 1, 2, 3]  # 0 to 2 are one thread


def test_reply_order_is_registered(spark, tmp_path):
    draw = random.Random(19)
    rows = [(1, k, "u", f"> message {k - 1} says it\nmessage {k} says it" if k and draw.random() < 0.5 else f"message {k} says it") for k in range(400)]
    rows += [(c, k, "u", "some words") for c in (0, 2, 3) for k in range(5)] + [(None, 1, "u", "x")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = registry.queries()["op4_quote_links"](spark, str(tmp_path)).collect()
    by = {}
    for r in found:
        by.setdefault(r["conv_id"], []).append((r["root_turn"] or 0, r["depth"], r["turn"], r["place"]))
        assert r["root_conv"] == r["conv_id"]
    assert len(found) == len(rows) and max(d for _, d, _, _ in by[1]) > 2
    assert all([p for *_, p in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_quotes_of_parts(spark):
    rows = [
        (1, 0, "u", "First thing I say. Second thing I say here. Third one.\nA line of its own here"), (1, 1, "a", "> Second thing I say here.\nwhy"), (1, 2, "a", "> A line of its own here\nyes please"),
        (1, 3, "u", "> yes please\ngood"), (1, 4, "u", "> First thing I say. Second thing I say here.\nok then"), (2, 0, "u", "> yes please\nelsewhere"),
        (0, 5, "u", "> said by two of them\nsaid by two of them"), (7, 0, "u", "said by two of them"),
    ]
    found = quote_links(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    parents = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in found}
    none = (None, None)
    assert parents == {(1, 0): none, (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 2), (1, 4): (1, 0), (2, 0): none, (0, 5): (7, 0), (7, 0): none}
    assert {r["turn"]: r["n_linked"] for r in found if r["conv_id"] == 1} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def brute_passages(text):
    """Level and body of the passages of a text, line by line."""
    lines, cuts = [], 0
    for x in re.split("\r\n|\n|\r", text):
        marks = re.match(r"((?:[ \t]*>)+)", x)
        body = x[marks.end() :] if marks else x
        level, body = (marks.group().count(">") if marks else 0) + cuts, body.strip(" ")
        if re.fullmatch(r"-{2,} *original message *-{2,}", body, re.I):
            cuts, body = cuts + 1, ""
        elif cuts and re.match("(from|sent|date|to|cc|subject): ", body, re.I):
            body = ""
        lines.append([level, body])
    shown = []
    for k, (level, body) in enumerate(lines):
        after = [x for x in lines[k + 1 : k + 3]]
        quote = after and (after[0][0] > level or (after[0][1] == "" and len(after) > 1 and after[1][0] > level))
        shown.append((level, "" if quote and re.fullmatch("on .+ wrote:", body, re.I) else body))
    found, last = [], (0, "")
    for level, body in shown:
        if body and last[1] and last[0] == level:
            found[-1] = (level, f"{found[-1][1]}\n{body}")
        elif body:
            found.append((level, body))
        last = (level, body)
    return found


LINES = ["", " ", "some words here", "yes please", "> quoted words here", ">> a deeper one", " > > as deep", "On Monday Ann wrote:", "> On Monday Ben wrote:", "-----Original Message-----", "From: Ann", "Subject: it", "\x01 odd \x02a mark", "a:b"]


def test_passages_against_brute_force(spark):
    from strandlog.llm.quote_links import passages

    draw = random.Random(24)
    texts = ["\n".join(draw.choices(LINES, k=draw.randrange(0, 12))) for _ in range(400)]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", passages(F.col("t")).alias("p")).collect()
    assert [[tuple(p) for p in r["p"]] for r in sorted(found)] == [brute_passages(t) for t in texts]


def brute_links(rows):
    """(conv_id, turn) to (parent conversation, parent turn, links), by looking every unit of every quote up everywhere."""
    squeezed = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    units = lambda body: list(dict.fromkeys([body, *body.split("\n"), *re.split(r"(?<=[.!?])\s+", body.replace("\n", " "))]))
    wrote = {}
    for c, t, _, text in rows:
        for level, body in brute_passages(text):
            if level == 0:
                for u in units(body):
                    of = wrote.setdefault(squeezed(u), {})
                    of[c] = min(t, of.get(c, t))
    out = {}
    for c, t, _, text in rows:
        best, linked = [], 0
        for at, (level, body) in enumerate(brute_passages(text)):
            hits = []
            for k, u in enumerate(units(body) if level else []):
                words = len(re.split(r"\s+", u))
                if k and words < 3:
                    continue
                of = wrote.get(squeezed(u), {})
                if of.get(c, t) < t:
                    hits.append((-len(u), 0, k, (c, of[c])))
                elif words >= 3 and (others := sorted(x for x in of.items() if x[0] != c)):
                    hits.append((-len(u), 1, k, others[0]))
            if hits:
                linked += 1
                longest = min(hits)
                best.append((longest[1], level, at, longest[3]))
        out[c, t] = (*min(best)[3], linked) if best else (None, None, 0)
    return out


def test_links_against_brute_force(spark):
    """Threads with nested, trimmed, short and introduced quotes, within and across conversations."""
    draw = random.Random(25)
    word = lambda: draw.choice(["tea", "rain", "stone", "light", "river", "song", "yes", "no", "please", "late"])
    sentence = lambda: " ".join(word() for _ in range(draw.randrange(1, 7))).capitalize() + draw.choice([".", "!", "?"])
    rows, texts = [], []
    for c in range(30):
        said = []
        for t in range(draw.randrange(1, 9)):
            parts = []
            for _ in range(draw.randrange(0, 3)):
                source = draw.choice(said if said and draw.random() < 0.8 else texts or [""])
                kept = source.split("\n")
                kept = draw.choice([kept, kept[:1], [draw.choice(kept).split(". ")[0]]])
                parts += draw.choice([[], ["On Monday Ann wrote:"]]) + [draw.choice([">", "> "]) + x for x in kept]
            parts += [""] + [" ".join(sentence() for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(1, 3))]
            text = "\n".join(parts)
            rows.append((c, t, "u", text))
            said.append(text)
            texts.append(text)
    found = quote_links(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    expected = brute_links(rows)
    assert {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"], r["n_linked"]) for r in found} == expected
    assert sum(p[0] is not None for p in expected.values()) > 40 and any(p[0] not in (None, k[0]) for k, p in expected.items())


def test_a_message_of_many_lines(spark):
    text = "\n".join(f"{'> ' * (k % 3)}line {k} of it" for k in range(20_000))
    found = quote_links(spark.createDataFrame([(1, 0, "u", text)], "conv_id bigint, turn bigint, role string, text string")).first()
    assert found["n_quotes"] == sum(k % 3 > 0 for k in range(20_000))


def test_raking_meets_its_targets(spark):
    draw = random.Random(10)
    rows = [(k, " ".join(["w"] * draw.randrange(1, 50)), draw.choice(["s1", "s1", "s2"]), draw.choice(["en", "en", "en", "de"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("s1", 0.5), ("s2", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "lang string, share double")}
    made = raking.mix(docs, targets=targets).withColumn("w", F.col("tokens") * F.col("weight"))
    total = made.agg(F.sum("w")).first()[0]
    for dim, aim in (("source", {"s1": 0.5, "s2": 0.5}), ("lang", {"en": 0.6, "de": 0.4})):
        got = {r[dim]: r["w"] / total for r in made.groupBy(dim).agg(F.sum("w").alias("w")).collect()}
        assert all(abs(got[v] - a) < 1e-3 for v, a in aim.items())
    assert made.agg(F.max("prob")).first()[0] == 1.0


def test_raking_as_in_sql(spark, tmp_path, monkeypatch):
    draw = random.Random(11)
    rows = [(k, draw.choice(["w 1 2 3", "see the license", "## ** ||", "plain words here", None]), draw.choice(["s1", "s2", None]), draw.choice(["en", "de"])) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(map(repr, c.sql(raking.oracle()).fetchall()))
    assert sorted(repr(tuple(r)) for r in raking.mix(docs).collect()) == expected
    before = {r["doc_id"]: r for r in raking.mix(docs).collect()}
    few = {r["doc_id"]: r for r in raking.mix(docs, rounds=3).collect()}
    monkeypatch.setattr(raking, "PARTITION_CELLS", 3)
    assert {r["doc_id"]: r for r in raking.mix(docs, rounds=3).collect()} == few
    monkeypatch.undo()
    kept = raking.mixed_documents(docs.withColumn("_source", F.lit(1)).withColumn("prob", F.lit(2)))
    assert kept.columns == [*docs.columns, "_source", "prob"] and {r["doc_id"] for r in kept.collect()} == {k for k, r in before.items() if r["sampled"]}


def test_raking_tells_what_it_misses(spark):
    docs = spark.createDataFrame([(1, "a b c", "s1", "en"), (2, "a b c", "s2", "de")], "doc_id bigint, text string, source string, lang string")
    # s1 is en and s2 is de, so these contradict each other
    targets = {"source": spark.createDataFrame([("s1", 0.9), ("s2", 0.1)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.1), ("de", 0.9)], "lang string, share double")}
    assert raking.mix(docs, targets=targets).first()["residual"] > 0.5 and raking.mix(docs).first()["residual"] == 0
