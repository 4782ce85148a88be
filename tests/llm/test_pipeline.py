import random

import corpus_pipeline
from strandlog.llm.unigram_pieces import Encoder, Pieces


def test_stages(spark, tmp_path):
    draw = random.Random(12)
    syllables = {"en": ["th", "er", "on", "an", "re"], "de": ["sch", "ü", "ent", "ich", "ung"]}
    text = lambda lang, n: " ".join("".join(draw.choices(syllables[lang], k=draw.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang, 120), lang, draw.choice(["a", "b"])) for k, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[0][1], "en", "a"), (201, rows[1][1] + " mehr", "de", "b"), (202, "12 34", "en", "a"), (203, None, None, None)]
    passage = text("en", 80)
    rows += [(300 + k, f"{text('en', 60)} {passage}", "en", "a") for k in range(3)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    told = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} == {r[0] for r in rows} - {202, 203}
    first = corpus_pipeline.near_copies(spark, told, str(tmp_path))
    assert {r["doc_id"] for r in first.collect()} == {r[0] for r in rows} - {200, 201, 202, 203}
    cut = corpus_pipeline.repeated_passages(spark, first, str(tmp_path))
    assert cut.columns == docs.columns and cut.count() == first.count()
    assert all(passage not in r["text"] and r["n_chars"] == len(r["text"]) for r in cut.where("doc_id >= 300").collect())
    mixed = corpus_pipeline.mixture(spark, cut, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert mixed.columns == docs.columns and 0 < len(texts) <= first.count()
    made = Encoder(Pieces.from_file())
    for r in corpus_pipeline.encoding(spark, mixed, str(tmp_path)).collect():
        assert made.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert {r["doc_id"] for r in whole} == set(texts)


def test_unlearned_scripts_go(spark, tmp_path):
    draw = random.Random(15)
    syllables = {"en": ["th", "er", "on", "an", "re"], "de": ["sch", "ü", "ent", "ich", "ung"]}
    word = lambda parts, n: "".join(draw.choices(parts, k=n))
    real = [(k, " ".join(word(syllables[lang], draw.randrange(1, 4)) for _ in range(draw.randrange(10, 80))), lang) for k, lang in enumerate(["en", "de"] * 60)]
    scripts = [(0x430, 0x450), (0x3B1, 0x3C9), (0xE01, 0xE2E), (0x4E00, 0x9FFF)]
    junk = [(1000 + k, " ".join(word([chr(c) for c in range(*scripts[k % 4])], draw.randrange(2, 10)) for _ in range(60)), None) for k in range(80)]
    docs = spark.createDataFrame(real + junk, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()} == {r[0] for r in real}
