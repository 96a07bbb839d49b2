"""The pipeline's stages against plain versions on the smallest table, and run() as their chain."""

from collections import defaultdict

import pytest

import corpus_pipeline
from gridloom.llm import queries, quality
from gridloom.llm.common import save
from tests.llm.test_ops import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(save(f(spark, out[-1], SF), "stage"))
    return out


def table(df):
    return {r.doc_id: tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS


def test_quality_keeps_what_scores(spark, stages):
    docs = stages[0]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    got = table(stages[1])
    assert set(got) == want and all(table(docs)[i] == row for i, row in got.items()) and 0 < len(want) < docs.count()


def test_near_copies_leave_one_of_a_group(stages):
    rows = table(stages[1])

    def shingles(text):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(r[1]) for i, r in rows.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for pair in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        a, b = sets[pair[0]], sets[pair[1]]
        if len(a & b) >= 0.8 * len(a | b):
            x, y = find(pair[0]), find(pair[1])
            root[max(x, y)] = min(x, y)
    got = table(stages[2])
    assert set(got) == {find(i) for i in sets} and all(rows[i] == r for i, r in got.items())


def test_surrogates_change_texts_alone(stages):
    before, after = table(stages[2]), table(stages[3])
    assert set(before) == set(after)
    changed = {i for i in before if before[i][1] != after[i][1]}
    assert changed == {i for i, r in before.items() if r[1] and any(x in r[1] for x in ("@mail", "555-", 'token = "')) } | changed
    for i, (_, text, lang, source, n) in after.items():
        assert "@mail" not in text and (lang, source) == before[i][2:4] and n == len(text)


def test_mixing_selects_rows(stages):
    before, after = table(stages[3]), table(stages[4])
    assert 0 < len(after) < len(before) and all(before[i] == r for i, r in after.items())


def test_packing_holds_all(stages):
    from gridloom.llm.packing import byte_bpe

    encode = byte_bpe(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {i: [*encode(r[1] or "").tolist(), 0] for i, r in table(stages[4]).items()}
    assert check_pieces(stages[5].toPandas(), want, defaultdict(lambda: 1)) > 0.97


def test_run_is_the_chain(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect()))
    assert got == sorted(map(tuple, stages[5].select(*key).collect()))
