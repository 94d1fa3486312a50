import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASH = ("_text", "_id", "_h", "node", "bucket", "shard", "slot", "size", "score", "ids", "length", "class", "bands", "start", "item_id", "_b", "_n", "_rank", "toxic", "digest", "kept")
ODD = [None, "", " ", "\n\n", "a", "a b c", "é" * 5, "x" * 40_000, "word " * 30_000, "😀 ﬁ İ ß\x00\x1c z", "<|endoftext|> ~ ~~ <|ENDOFTEXT|>", "token = \"0123456789abcdef0123456789abcdef\""]


def rows(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS)


def odd_documents(spark):
    """Null and repeated ids, null, empty, long and repeated texts, nulls elsewhere, columns with clashing names."""
    data = [*rows(ODD), *rows(["a b c", "same text here"], 3), (None, "no id at all", None, None, None), (None, None, None, None, None), (3, "a b c", "en", "s", 5)]
    df = spark.createDataFrame(data, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(-1) for c in CLASH})


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def vocabulary(n=400, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))
