"""Registered text queries against their SQL, and the pipeline's stages against the operators."""

import os
import random
import re
import sys

import duckdb
import pytest
from test_llm_operators import brute_components, brute_cover, brute_print
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402
from flowlens.llm import bpe, queries  # noqa: E402
from flowlens.session import stage  # noqa: E402

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and clashing columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    toxic = "you idiot, you stupid worthless loser and pathetic clown"
    rows = [(i, f"Sentence {i} of a plain text, with some words {i * 7} in it. " * 3, "en", "s", 10) for i in range(40)]
    rows += [(100 + i, toxic + f" number {i} " + "again and again " * i, "en", "s", 10) for i in range(12)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "", "en", "s", 0), (None, "text without an id", "en", "s", 1), (None, None, None, None, None)]
    rows += [(300, "long " * 40_000 + "mail me a@b.example.com", "en", "s", 1), (5, rows[5][1], "en", "s", 10), (5, rows[5][1], "en", "s", 10), (301, rows[5][1], "en", "s", 10)]
    clash = "fp string, key string, th string, score string, ids string, level string, row string, at string"
    more = [r + ("c",) * 8 for r in rows]
    spark.createDataFrame(more, f"{EMPTY}, {clash}").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "some item that nobody has copied here at all"), (2, None), (None, "text without an id")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/x", "<p>Some text here.</p>"), (None, None, None), (2, "", ""), (2, "", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, odd_dir, name):
    rows = queries.QUERIES[name](spark, odd_dir).collect()
    source = "pages" if name in ("op4_html_extract", "op9_url_filter") else "documents"
    if name not in ("op8_decontaminate", "op12_divergence"):  # pairs
        assert len(rows) == spark.read.parquet(f"{odd_dir}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("sf", [SF, "odd", "empty"])
def test_pipeline_stages(spark, odd_dir, empty_dir, sf):
    sf = {"odd": odd_dir, "empty": empty_dir}.get(sf, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    texts = {}
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, before, sf), f"test-{name}")
        if name != "bpe":
            assert after.columns == before.columns
        texts[name] = after
        before = after
    n = {k: v.count() for k, v in texts.items()}
    assert n["toxicity"] >= n["simhash"] >= n["decontaminate"] == n["pii"] == n["bpe"]
    if sf == empty_dir:
        assert set(n.values()) == {0}
        return
    assert n["toxicity"] < docs.count()
    left = texts["simhash"].select("doc_id", "text").collect()
    again = queries.simhash.near_copies(texts["simhash"]).collect()
    assert len({r["fingerprint"] for r in again}) == len(left)  # no two survivors are copies
    t = bpe.tokenizer(bpe.default_path())
    want = {r["doc_id"]: t.encode(r["text"] or "") for r in texts["pii"].select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in texts["bpe"].collect()} == want
    assert texts["bpe"].filter("NOT decodes OR n_tokens <> size(ids)").count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    """A corpus whose fate is known: who is toxic by plan, copies and leaks by brute force, masks by hand, tokens by another library."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioubdgklmnprst") for _ in range(r.randint(3, 8)))
    vocabulary = [word() for _ in range(600)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(3)]
    texts, toxic, masks = [prose(r.randint(60, 140)) for _ in range(60)], [0] * 60, {}
    for k in range(16):
        texts.append(f"{prose(30)} you stupid idiot, worthless pathetic loser {prose(20)} such a moron and clown")
        toxic.append(1)
    for k in range(6):  # exact copies, and copies with one word more at the end of long texts
        texts += [texts[k], texts[k + 10] + " " + prose(1)]
        toxic += [0, 0]
    halves = [t.split() for _, t in items]
    texts += [f"{prose(20)} {items[0][1].upper()} {prose(20)}", f"{prose(15)} {' '.join(halves[1][15:])} {prose(3)} {' '.join(halves[1][:15])}", f"{prose(40)} {' '.join(halves[2][:12])}"]
    toxic += [0, 0, 0]
    for text, masked in (("write to ann.lee@mail.example.org soon", "write to <EMAIL> soon"), ("from 10.20.30.40 today", "from <IP> today"), ("call +49 30 1234567 now", "call <PHONE> now"),
                         ("card 4111 1111 1111 1111 here", "card <CARD> here"), ("password = 'p&s (w)!rd9' here", "password = '<SECRET>' here"), ("the account: is closed", "the account: is closed")):
        a, b = prose(40), prose(30)
        texts.append(f"{a} {text} {b}")
        masks[texts[-1]] = f"{a} {masked} {b}"
        toxic.append(0)
    texts += ["", None]
    toxic += [0, 0]
    rows = [(i, t, "xx", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, EMPTY).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    left = [(i, t) for (i, t, *_), x in zip(rows, toxic) if not x]
    groups = brute_components([(i, brute_print(t)) for i, t in left])
    left = [(i, t) for k, (i, t) in enumerate(left) if groups[k] == i]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    left = [(i, t) for i, t in left if not any(brute_cover(words(x), words(t), 5) >= 0.8 * len(words(x)) for _, x in items if set(words(x)) & set(words(t)))]
    other = Tokenizer.from_file(bpe.default_path())
    want = {i: other.encode(masks.get(t, t or ""), add_special_tokens=False).ids for i, t in left}
    got = corpus_pipeline.run(spark, d).collect()
    assert {x["doc_id"]: x["ids"] for x in got} == want and all(x["decodes"] and x["n_tokens"] == len(x["ids"]) for x in got)
    assert len(want) < len([x for x in toxic if not x])


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
