import random

from sievewright.llm import substring_dedup as S


def brute(rows, least):
    seen, spans = set(), set()
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - least + 1):
            k = tuple(w[s : s + least])
            if k in seen:
                gone[s : s + least] = [True] * least
            seen.add(k)
        start = None
        for j, g in enumerate([*gone, False]):
            if g and start is None:
                start = j
            elif not g and start is not None:
                spans.add((i, start, j))
                start = None
    return spans


def run(df, least, gram):
    return {(r["doc_id"], r["start_word"], r["end_word"]) for r in S.repeated_spans(df, min_words=least, gram=gram).collect()}


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [word() for _ in range(rng.randrange(0, 25))]
            if rng.random() < 0.6:
                piece = list(rng.choice(shared))
                if rng.random() < 0.5 and piece:
                    piece[rng.randrange(len(piece))] = word()
                w += piece
        rows.append((i, " ".join(w)))
    return rows


def test_matches_brute_force(docs_of):
    for seed in (1, 2):
        rows = corpus(seed) + [(900, "a " * 200), (901, "a b c " * 60), (902, "b c a " * 20 + "x"), (903, "a " * 9)]
        assert run(docs_of(rows), 12, 5) == brute(rows, 12)


def test_tiny_batches(spark, docs_of):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = corpus(4)
        assert run(docs_of(rows).repartition(3), 10, 4) == brute(rows, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_passage_of_production_length(docs_of):
    rng = random.Random(7)
    fill = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = fill(55)
    rows = [(1, f"{fill(30)} {passage}"), (2, f"{passage}\n{fill(300)}"), (3, fill(500)), (4, f"{fill(10)} {' '.join(passage.split()[:49])}")]
    df = docs_of(rows)
    spans = S.repeated_spans(df)
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["first_id"]) for r in spans.collect()] == [(2, 0, 55, 1)]
    kept = {r["doc_id"]: r["text"] for r in S.remove_spans(df, spans).collect()}
    assert kept[2] == rows[1][1].split("\n")[1] and kept[1] == rows[0][1] and kept[3] == rows[2][1]


def test_edge_cases(docs_of):
    text = " ".join(f"v{k}" for k in range(70))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "short"), (5, text)]
    df = docs_of(rows).selectExpr("*", "1 AS id", "2 AS digest", "3 AS places", "'p' AS part")
    assert run(df, 50, 16) == {(5, 0, 70)}
    assert S.repeated_spans(docs_of([])).count() == 0


def brute_in(rows, refs, least):
    known = {tuple(w[s : s + least]) for w in (t.split() for i, t in refs if i is not None and t) for s in range(len(w) - least + 1)}
    out = set()
    for i, t in {(i, t) for i, t in rows if i is not None and t}:
        w = t.split()
        gone = [False] * (len(w) + 1)
        for s in range(len(w) - least + 1):
            if tuple(w[s : s + least]) in known:
                gone[s : s + least] = [True] * least
        cut = [k for k in range(len(w) + 1) if gone[k] != (k > 0 and gone[k - 1])]
        out |= {(i, a, b) for a, b in zip(cut[::2], cut[1::2])}
    return out


def test_broadcast_automata_of_a_reference(spark, docs_of):
    rows, refs = corpus(5) + [(700, None), (None, "x " * 40), (701, "")], corpus(5)[10:30:3] + [(None, "no id"), (99, None), (98, ""), (97, "a b " * 30)]
    reference = spark.createDataFrame([(f"r{i}" if i is not None else None, t) for i, t in refs], "ref string, body string")
    df = docs_of(rows + rows[:3])
    for shard_bytes in (1, 1 << 20):
        out = S.spans_in(df, reference, ref_id_col="ref", ref_text_col="body", min_words=10, shard_bytes=shard_bytes)
        got = out.collect()
        assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == brute_in(rows, refs, 10) and len(got) == len({tuple(r) for r in got}) > 20
        assert out.columns == ["doc_id", "digest", "start_word", "end_word", "first_id"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        # batches in which nothing is found, and ids of a narrow type
        narrow = spark.createDataFrame([(7, refs[0][1])], "ref smallint, body string")
        out = S.spans_in(df.coalesce(1), narrow, ref_id_col="ref", ref_text_col="body", min_words=10).collect()
        assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in out} == brute_in(rows, [(7, refs[0][1])], 10) and {r["first_id"] for r in out} == {7}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert S.spans_in(df, reference.limit(0), ref_id_col="ref", ref_text_col="body").count() == 0
    assert S.spans_in(docs_of([]), reference, ref_id_col="ref", ref_text_col="body").count() == 0
    try:
        S.spans_in(df, reference, ref_id_col="ref", ref_text_col="body", reference_bytes=10)
        raise AssertionError("no check of the size")
    except ValueError:
        pass


def test_hot_passage_and_ids_of_other_types(spark, docs_of):
    rng = random.Random(3)
    hot = " ".join(f"h{k}" for k in range(30))
    rows = [(i, f"{' '.join(f'u{rng.randrange(10**9)}' for _ in range(6))} {hot} end{i}") for i in range(300)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        df = docs_of(rows).repartition(3)
        assert run(df, 12, 5) == brute(rows, 12)
        named = df.withColumn("doc_id", S.F.concat(S.F.lit("doc-"), "doc_id"))
        spans = S.repeated_spans(named, min_words=12, gram=5)
        got = spans.collect()
        assert len(got) == 299 and {(r["start_word"], r["end_word"]) for r in got} == {(6, 36)} and all(r["first_id"].startswith("doc-") for r in got)
        assert sum(hot in r["text"] for r in S.remove_spans(named, spans).collect()) == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
