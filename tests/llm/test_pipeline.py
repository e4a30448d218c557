"""The pipeline against brute-force versions of its stages, each on what its predecessor kept; operators on small tables."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from metrelle.llm import bpe, common, decontamination
from test_lines import brute as lines_brute
from test_near import brute as near_brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        windows = {tuple(v[i : i + n]) for i in range(max(1, len(v) - n + 1))} if v else set()
        for g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def encoding():
    ranks = bpe.ranks_of(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_row(enc, d, text):
    ids = enc.encode_ordinary(text or "")
    return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def prose(r, lang, n):
    parts = {"en": ["the", "and", "with", "thing", "other", "ation"], "de": ["der", "und", "schön", "über", "keit", "nicht"], "fr": ["le", "été", "que", "eau", "ç", "ment"]}[lang]
    return [r.choice(parts) + "".join(r.choice(parts) for _ in range(2)) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    items = [(i, " ".join(prose(r, "en", k))) for i, k in enumerate([15, 30, 4, 10])] + [(9, None), (10, "")]
    docs = []
    for d in range(150):
        lang = r.choice(["en", "de", "fr"])
        w = prose(r, lang, r.randint(30, 90))
        if d % 9 == 0:
            w[5:5] = words(items[d % 2][1])[:14]
        text = " ".join(w[:20]) + "\n" + " ".join(w[20:])
        if d % 7 == 3 and docs:
            text = docs[-1][1] + " " + " ".join(prose(r, lang, 2))
        docs.append((d, text, lang, "s", len(text)))
    docs += [(500, None, "en", "s", 0), (501, "", "de", "s", 0), (502, docs[0][1], "en", "s", 1), (503, "1234 5678", "en", "s", 9)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages_match_brute_force(spark, tables):
    folder, items = tables
    docs, enc = spark.read.parquet(f"{folder}/documents.parquet"), encoding()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert after.columns == columns
            after = spark.createDataFrame(after.collect(), SCHEMA)
            kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language_id":
            assert set(before) - set(kept) == {500, 501, 503}
        elif name == "line_dedup":
            want = {d: t for d, t in lines_brute(list(before.items())) if t == before[d] or (t or "").strip()}
            assert kept == want
        elif name == "near_duplicates":
            root = {row[0]: row[1] for row in near_brute(list(before.items()))}
            assert set(kept) == {d for d in before if root[d] == d}
        elif name == "decontamination":
            assert set(kept) == {d for d, t in before.items() if not contaminated(t, items)[1]} and set(kept) < set(before)
        else:
            assert {tuple(r) for r in after.collect()} == {token_row(enc, d, t) for d, t in before.items()}
        docs = after
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == {tuple(r) for r in docs.collect()}


def test_empty_table(spark, tables):
    folder, _ = tables
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_whole_pipeline_of_an_empty_table(spark, tables, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_matches_brute_force(spark, tables, monkeypatch):
    folder, items = tables
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs += [(700, " ".join(["word"] * 30000) + " " + items[1][1]), (None, items[0][1]), (600, items[2][1].upper() + "!"), (601, items[2][1]), (601, items[2][1])]
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, key string, row int")
    got = Counter(tuple(r) for r in decontamination.digest(frame, spark.read.parquet(f"{folder}/benchmark.parquet")).collect())
    want = Counter()
    for d, t in docs:
        n, hit, found = contaminated(t, items)
        want[d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in decontamination.remove_hits(frame.filter("doc_id = 600 OR doc_id = 9"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert clean[600] == "!" and not contaminated(clean[9], items)[1]
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert Counter(tuple(r) for r in decontamination.digest(frame, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()) == want
    monkeypatch.undo()
    none = frame.filter("false")
    assert decontamination.digest(none, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
