"""The pipeline's stages against brute force, each on its own input, and the registered names."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from auditlake.llm.quality_rules import STOP_WORDS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRET = re.compile(r'(?<=token = ")[0-9a-f]{40}(?=")')
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and"]) if i % 4 == 0 else word() for i in range(n))
    passage = prose(60)
    out = []
    for i in range(40):
        text = prose(rnd.randint(60, 160))
        if i % 5 == 1:
            text = out[-1][1]
        elif i % 5 == 2:
            w = out[-2][1].split(" ")
            w[len(w) // 2] = word()
            text = " ".join(w)
        elif i % 5 == 3:
            text = text + "\n" + passage + " " + prose(20)
        elif i % 10 == 4:
            text = " ".join(f"{w}&&&" for w in text.split(" "))
        if i % 4 == 0:
            text = text + ' token = "' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + '" card 4111' + "".join(rnd.choice("0123456789") for _ in range(12))
        out.append((i * 3, text))
    return [*out, (500, None), (501, ""), (502, "short text")]


def kept_by_quality(text):
    w = WORD.findall(text or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + d for i, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    stops = sum(x.lower() in STOP_WORDS for x in w)
    return 200 * len(w) <= 100 * chars <= 1200 * len(w) and 100 * symbols <= 20 * len(w) and 100 * stops >= 2 * len(w) and 100 * (len(lines) - len(set(lines))) <= 60 * len(lines)


def without_near_copies(docs):
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs.items() for w in [WORD.findall(t.lower())]}
    group = {d: d for d in docs}
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return {d: docs[d] for d in ids if group[d] == d}


def without_passages(docs, k=13):
    owner, out = {}, {}
    words = {d: WORD.findall(t) for d, t in docs.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            owner.setdefault(tuple(words[d][i : i + k]), d)
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if owner[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        if len(gone) < len(w):
            out[d] = docs[d] if not gone else " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def test_stages_match_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    source = rows()
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in source], COLUMNS)
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["quality_rules", "jaccard_join", "substring_dedup", "secret_scan", "packing"]
    want = {d: t for d, t in source if kept_by_quality(t)}
    steps = [
        ("quality_rules", lambda docs: docs), ("jaccard_join", without_near_copies), ("substring_dedup", without_passages),
        ("secret_scan", lambda docs: {d: SECRET.sub("[SECRET]", t) for d, t in docs.items()}),
    ]
    assert 0 < len(want) < len(source)
    sizes = [len(want)]
    for name, brute in steps:
        table = corpus_pipeline.stage(functions[name](spark, table, ""), name)
        want = brute(want)
        sizes.append(len(want))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in table.collect()}
        assert {d: t for d, (t, _) in got.items()} == want
        assert name in ("quality_rules", "jaccard_join") or all(n == len(t) for t, n in got.values())
    assert sizes[2] < sizes[1]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = functions["packing"](spark, table, "").collect()
    for d, t in want.items():
        own = sorted((r for r in pieces if r["doc_id"] == d), key=lambda r: r["start"])
        assert [i for r in own for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_extended_and_shortened_copies_go_before_passages_are_cut(spark):
    rnd = random.Random(5)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    docs = {}
    for i in range(50):
        w = prose(rnd.randint(80, 250))
        k = len(w) * rnd.randint(10, 25) // 100
        at = rnd.randint(0, len(w) - k)
        other = [w + prose(k), w[:at] + prose(k) + w[at:], w[k:], w[:at] + w[at + k :]][i % 4]
        docs[i * 10 + i % 3], docs[i * 10 + (i + 1) % 3] = " ".join(w), " ".join(other)
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], COLUMNS)
    functions = dict(corpus_pipeline.STAGES)
    apart = without_near_copies(docs)
    assert 55 < len(apart) < 90
    table = corpus_pipeline.stage(functions["jaccard_join"](spark, table, ""), "jaccard_join")
    assert {r["doc_id"]: r["text"] for r in table.collect()} == apart
    assert {r["doc_id"]: r["text"] for r in functions["substring_dedup"](spark, table, "").collect()} == without_passages(apart)


def test_a_near_copy_takes_no_other_text_of_its_id_along(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(3, text), (5, text + " more"), (5, "another text that nobody else has at all"), (None, text)]
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], COLUMNS)
    out = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, table, "")
    assert out.columns == table.columns and {(r["doc_id"], r["text"]) for r in out.collect()} == {docs[0], docs[2], docs[3]}


CLASHES = ("hash", "kept", "_text", "_hash", "_left", "_spans", "_row", "n_words", "component_id", "start")


def test_extra_columns_with_clashing_names_stay(spark):
    source = [(d, t) for d, t in rows()] + [(None, rows()[0][1]), (None, None)]
    table = spark.createDataFrame([(d, t, "en", "s", 0, *[f"{c} of {d}" for c in CLASHES]) for d, t in source], COLUMNS + "".join(f", `{c}` string" for c in CLASHES))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(function(spark, table, ""), name)
        assert out.columns == table.columns and 0 < out.count() <= table.count()
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in out.collect() for c in CLASHES)
        table = out
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, table, "").collect()} == {r["doc_id"] for r in table.collect()}


def test_stages_of_an_empty_table(spark):
    table = spark.createDataFrame([], COLUMNS)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, table, "").collect() == []


def test_stages_with_a_text_of_20_mb(spark):
    rnd = random.Random(3)
    long = " ".join(f"{rnd.choice(['the', 'of', 'and'])} w{rnd.randrange(10**7)}" for _ in range(1_500_000))
    table = spark.createDataFrame([(1, long, "en", "s", 0), (2, "the short end of it", "en", "s", 0)], COLUMNS)
    for name, function in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.stage(function(spark, table, ""), name)
    assert [(r["doc_id"], len(r["text"])) for r in table.collect()] == [(1, len(long))]
    tokens = corpus_pipeline.STAGES[-1][1](spark, table, "")
    assert tokens.groupBy("doc_id").agg({"length": "sum"}).first()[1] == tokens.first()["doc_tokens"]


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_quality_sql_gives_the_same_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows()], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = __spark_entry__.queries()["op8_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["op8_quality_rules"])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cursor.fetchall())
