"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest

import corpus_pipeline
from quartzgraph.llm import chat_format, decontaminate, language_id, mixing, near_dedup, repetition, secrets, toxicity, training_order, url_filter
from quartzgraph.llm.common import written

CLASH = ["th", "fp", "h", "k", "block", "rule", "score", "w", "p", "slot", "a", "b", "n_words", "words", "held_out", "root", "hub", "label", "key", "d", "id", "x"]
PLAIN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"word{i % 7919}x{i}" for i in range(60_000))
ROWS = [
    (1, PLAIN, "en", "s0", 10), (1, PLAIN, "en", "s0", 10), (2, PLAIN + " phi", "en", "s0", 10), (None, PLAIN, None, None, None), (None, None, None, None, None),
    (3, None, "en", "s1", 0), (4, "", "de", "s1", 0), (5, " \n\t", None, "s1", 0), (6, LONG, "en", "s2", 10), (7, "x", "de", None, 1), (None, "only here and without any id at all", "en", "s1", 1),
    (8, "12 34 ## 1d10t", "de", "s2", 3), (-9, "Ünï cödé \U0001f600 tęxt", "de", "", 4),
]
COLS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, COLS)
    return df.selectExpr("*", *[f"'c' as `{c}`" for c in CLASH])


def items(spark, rows=((1, PLAIN), (2, None), (None, "x"), (4, ""), (5, PLAIN))):
    return spark.createDataFrame(list(rows), "item_id long, text string").selectExpr("*", *[f"1 as `{c}`" for c in CLASH])


def labels(spark, rows=((1, 0, 1), (2, 1, 0), (None, 1, 1), (3, 0, None), (6, 1, 1), (7, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").selectExpr("*", *[f"1 as `{c}`" for c in CLASH])


def each(spark, docs):
    yield "secrets", secrets.scan_secrets(docs)
    yield "near", near_dedup.near_duplicates(docs)
    yield "repetition", repetition.repetition(docs)
    yield "benchmark", decontaminate.contamination(docs, items(spark))
    yield "language", language_id.identify(docs, language_id.train(docs))
    yield "toxicity", toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark)))
    yield "shards", training_order.materialise(docs, tokenizer=None)


def test_odd_rows(spark):
    docs = frame(spark)
    got = {name: df.collect() for name, df in each(spark, docs)}
    assert all(len(rows) == len(ROWS) for rows in got.values())
    near = got["near"]
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near if r["n_shingles"] and r["doc_id"] in (1, 2)} == {(1, 1, True), (2, 1, False)}
    assert {r["component_id"] for r in near if r["doc_id"] is None} == {1, None} and {(r["component_id"], r["n_shingles"]) for r in near if r["doc_id"] in (3, 4, 5)} == {(3, 0), (4, 0), (5, 0)}
    bench = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in got["benchmark"]}
    assert (1, 20, 2) in bench and (2, 20, 2) in bench and (7, 1, 1) in bench and (3, 0, 0) in bench and (6, 0, 0) in bench
    assert [r["kept"] for r in got["repetition"] if r["doc_id"] == 6] == [True]
    assert {r["lang_pred"] for r in got["language"] if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert sum(r["n_tokens"] for r in got["shards"]) == sum(len((r[1] or "").encode()) + 1 for r in ROWS)
    assert {r["n_tokens"] for r in got["shards"] if r["doc_id"] in (3, 4)} == {1}


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert all(df.count() == 0 for _, df in each(spark, docs))
    some = frame(spark)
    assert not any(r["contaminated"] for r in decontaminate.contamination(some, items(spark, ())).collect())
    model = toxicity.train(some, labels(spark, ()))
    assert {r["score"] for r in toxicity.score_toxicity(some, model).collect()} == {0.0}
    assert mixing.mix(docs).count() == 0 and mixing.placed(docs, mixing.weights(docs, "source", "text", 0.9, 2.0, 1.0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://EXAMPLE.com/en/x?y"), (6, "a://x.net/es/"), (6, "a://x.net/es/"), (None, "http://b.free-bets.org#f"), (7, "http://x.com"), (8, "http://q.www.example.com/en/"), (9, "a://b://c"), (10, "http://Ä.net\n/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", *[f"'c' as `{c}`" for c in [*CLASH, "host", "path", "said", "hit", "shard"]])
    for bound in (1 << 20, 0):
        got = sorted(map(str, url_filter.filter_urls(df, url_filter.label_listed, broadcast_bytes=bound).select("page_id", "host", "path", "rule", "verdict").toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
        want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "example.com", "/en/x", "example.com/en/", "block"), (6, "x.net", "/es/", "net/es/", "block"), (6, "x.net", "/es/", "net/es/", "block"),
                (None, "b.free-bets.org", "", None, "block"), (7, "x.com", "", None, "allow"), (8, "q.www.example.com", "/en/", "www.example.com/en/", "allow"), (9, "b:", "//c", None, "allow"), (10, "Ä.net\n", "/fr/", None, "allow")]
        assert got == sorted(str((float(i) if i is not None else None, *r)) for i, *r in want) or got == sorted(map(str, want))
    assert url_filter.filter_urls(df.limit(0), url_filter.label_listed).count() == 0


def test_chats(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 2, "ann", "ok"), (1, None, "system", "be"), (2, 0, "system", "alone"), (None, 0, None, "x"), (3, 500, "ann", "far"), (3, 500, "bob", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *[f"'c' as `{c}`" for c in [*CLASH, "speaker", "part", "size", "c", "cc", "bb"]])
    got = {(r["conv_id"], r["speaker"]): r for r in chat_format.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann"), (3, "bob")}
    r = got[(1, "ann")]
    assert r["text"] == "<|system|>\nbe<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nok<|end|>\n" and r["n_turns"] == 4
    said = [r["text"][int(a) : int(b)] for a, b in (x.split(":") for x in r["mask"].split(","))]
    assert said == ["hi<|end|>\n", "ok<|end|>\n"] and r["loss_chars"] == 20 and got[(3, "ann")]["n_turns"] == 2
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_long_dialogues(spark, duck, tmp_path, same_rows):
    """Whole dialogues of hundreds of turns and ties, and longer ones in consecutive parts whose masks go on, as the SQL has them."""
    rows = [(c, None if i % 3 else i % 40, ("ann", "bob", "system", None)[i % 4], f"t{i}\u00e9") for c in (None, 1) for i in range(2500)]
    rows += [(2, i, ("ann", "bob")[i % 2], f"u{i}") for i in range(500)] + [(3, 7, "ann", f"tie{i}") for i in range(700)] + [(4, i, "ann", None) for i in range(1025)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    same_rows(chat_format.rotate(df), duck(tmp_path).sql(chat_format.SQL_OP4))
    got = {}
    for r in sorted(chat_format.rotate(df).collect(), key=lambda r: r["part"]):
        got.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    assert [len(got[k]) for k in ((None, "ann"), (1, "unknown"), (2, "bob"), (3, "ann"), (4, "ann"))] == [3, 3, 1, 1, 2] and got[(3, "ann")][0]["n_turns"] == 700
    whole = {(c, s): t for c, s, _, _, _, t, _, _ in duck(tmp_path).sql(chat_format.SQL_OP4.replace("1024", "1000000")).fetchall()}
    for k, parts in got.items():
        text = "".join(r["text"] for r in parts)
        assert text == whole[k] and all(text.startswith(r["text"], r["start"]) for r in parts)
        said = [text[int(a) : int(b)] for r in parts for a, b in (x.split(":") for x in r["mask"].split(",") if x)]
        assert sum(map(len, said)) == sum(r["loss_chars"] for r in parts) and all(x.endswith(chat_format.END) and "<|" not in x[: -len(chat_format.END)] for x in said)


def test_mixing(spark):
    docs = frame(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and set(map(str, out.collect())) == set(map(str, docs.collect()))
    # rows without tokens or doc_id stay in a source that is held once
    bare = spark.createDataFrame([(i if i % 3 else None, None if i % 2 else "", "en", "s", 0) for i in range(200)] + [(None, f"a b c{i}", "en", "s", 0) for i in range(50)], COLS)
    assert mixing.mix(bare).count() == 250
    assert mixing.placed(bare, mixing.weights(bare, "source", "text", None, 2.0, 0.5)).filter("n_tokens > 0").select("h").distinct().count() == 25
    many = spark.createDataFrame([(i, f"w{i} " * 20, "en", f"s{0 if i < 600 else i % 7}", 1) for i in range(900)], COLS)
    plan = {r["source"]: r for r in mixing.weights(many, "source", "text", None, 3.0, None).collect()}
    reps = {s: r["budget"] / r["tokens"] for s, r in plan.items()}
    assert min(reps.values()) == pytest.approx(1.0, abs=1e-3) and max(reps.values()) == pytest.approx(3.0, abs=0.02)
    counts = {r["source"]: r["count"] for r in mixing.mix(many, max_repeats=3.0).groupBy("source").count().collect()}
    assert all(abs(counts[s] * 20 - plan[s]["budget"]) <= 20 for s in plan)
    placed = mixing.placed(many, mixing.weights(many, "source", "text", 0.97, 8.0, 1.0)).toPandas()
    w = placed.groupby("source")["weight"].first()
    import numpy as np

    assert -(w * np.log(w)).sum() == pytest.approx(0.97 * np.log(7), abs=1e-4)
    for _, g in placed.groupby("source"):
        g = g.sort_values("start")
        assert (g["start"].to_numpy()[1:] == (g["start"] + g["n_tokens"]).to_numpy()[:-1]).all() and g["start"].iloc[0] == 0


def test_stages(spark, tmp_path):
    """Every stage on odd rows, and on none; clean rows stay."""
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = written(frame(spark, rows), "docs")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = written(out, "docs")
        n = docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == n and (n > 0) == bool(rows)
    one = near_dedup.keep_one(frame(spark)).collect()
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == [-9, 1, 3, 4, 5, 6, 7, 8] and len(one) == 10
