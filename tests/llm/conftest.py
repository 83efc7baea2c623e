import random

import pytest

CLASHES = ["ids", "decoded", "n", "key", "label", "score", "kept", "component", "bucket", "doc", "start", "run", "length", "a", "b", "rep", "line", "count", "path", "n_lines", "text_sha256", "spans", "shard"]


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "Thin", "erat", "onou", "wh,", "st.", "éa", "ñe"]) + rng.choice(["", "a", "en", "ish"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with the awkward cases: null, empty, blank, one word, copies, near copies, shared lines and passages, a long one."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(5, 90)) for _ in range(25)]
    passage, line = words(rng, 60), "A line that many documents share."
    near = words(rng, 150).split()
    out = [None, "", "   ", " \n\t\n", "one", base[0], base[0], base[0] + "  ", base[0].upper(), *base]
    out += [f"{words(rng, 8)}\n{line}\n{words(rng, 5)} {passage} {words(rng, 6)}" for _ in range(6)]
    for k in range(6):
        w = list(near)
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += ["\n".join(line.lower() + "  " for _ in range(4)), words(rng, 6000), "x" * 5000, "ab" * 400, "日本語 テキスト 😀😀", "<|endoftext|> a<|startoftext|>b"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids out of order, one null id, one row twice, columns with names that operators use."""
    from pyspark.sql import functions as F

    rows = [(1000 - 7 * k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (None, None), (1000 - 7 * 12, texts[12])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASHES} | {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")}).cache()


@pytest.fixture(scope="session")
def plain(docs):
    """The rows with an id, each once: {doc_id: text}."""
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id is not None}
