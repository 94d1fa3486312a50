"""The registered queries over the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.common import materialise
    from tesselix.llm.packing import pieces, place
    from tesselix.llm.tokens import default_path

    cut = pieces(table(spark, sf_dir, "documents"), default_path(), 4096, 2)
    rows = materialise(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return place(rows, 4096)


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op4_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.simple8b import read_ids, write_ids
    from tesselix.llm.tokens import default_path

    files = write_ids(table(spark, sf_dir, "documents"), default_path(), 1)
    return read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesselix.llm.wordpiece import count_pieces

    return count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        (F.size("secrets") - F.size(of(base))).cast("long").alias("n_linked"),
    )


def op8_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.common import hot_keys, materialise, salted_join
    from tesselix.llm.media import read_media, store_texts

    rows = materialise(store_texts(table(spark, sf_dir, "documents")), "media-places")
    read = read_media(rows).select(
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        "media_bytes",
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("png %dx%d %d bit grey", "width", "height", "bits").alias("feature"),
    )
    return salted_join(rows.select("doc_id", "n_bytes", "digest"), read, "digest", "doc_id", hot_keys(rows, "digest")).drop("digest")


def op9_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.repeats import drop_repeats

    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.toxicity import fit, learnable, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_skip_chain_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.personal import KINDS, find_personal, learned

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal(docs, learned(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.periodic import find_runs

    found = find_runs(table(spark, sf_dir, "documents"), plant=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("_r", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_r.s")).alias("start"),
        F.col("_r.length").alias("length"),
        (-F.col("_r.p")).alias("period"),
        F.expr("1000 * _r.length div -_r.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselix.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_spaced_seed_decontamination, op2_min_slack_packing, op3_weighted_minhash, op4_simple8b_ids, op5_lpt_sharding, op6_longest_match_counts, op7_secret_linking, op8_tar_media, op9_repeated_phrases, op10_toxicity_fm, op11_skip_chain_personal, op12_periodic_runs, op13_filter_audit)}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{2FFF}\x{A000}-\x{10FFFF}]+|[\x{3000}-\x{9FFF}]')"
ORACLES: dict[str, str] = {
    # alignments by equal words, then windows of 15 words (or of the whole item) around the matches, a fifth unequal at most
    "op1_spaced_seed_decontamination": f"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p, len(w) AS n FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
b AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q, len(w) AS m, least(len(w), 15) AS l, least(len(w), 15) - least(len(w), 15) * 3 // 15 AS need FROM (SELECT item_id, {WORDS} AS w FROM benchmark)),
hit AS (SELECT doc_id, item_id, p - q AS shift, p, n, m, l, need FROM d JOIN b USING (word)),
likely AS (SELECT * FROM hit QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= need),
start AS (SELECT DISTINCT doc_id, item_id, shift, p - o AS s FROM likely, (SELECT unnest(range(15)) AS o) WHERE o < l AND p - o >= greatest(0, shift) AND p - o + l <= least(n, m + shift)),
best AS (SELECT doc_id, item_id, s, need, count(*) AS equal FROM start JOIN likely USING (doc_id, item_id, shift) WHERE p BETWEEN s AND s + l - 1 GROUP BY doc_id, item_id, shift, s, need)
SELECT doc_id, item_id, CAST(s AS INTEGER) AS start_word, CAST(equal AS INTEGER) AS equal_words FROM best WHERE equal >= need
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, s) = 1""",
    "op9_repeated_phrases": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win), (SELECT unnest(range(50)) AS o) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # equal words of a document by their distance; a run is an island of places whose words equal those that far on
    "op12_periodic_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
word AS (SELECT doc_id, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM island GROUP BY doc_id, s, len),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines, max_by(struct_pack(s := s, len := len, q := q), struct_pack(a := len, b := -s, c := -q)) AS r FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.len AS length, r.q AS period, 1000 * r.len // r.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
c AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS steps FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, fails, n, good, toxic, array_to_string(list_transform(steps, lambda i: chr(CAST(65 + i AS INTEGER))), '') AS filter_order, steps, list_position(list_transform(steps, lambda i: fails[1 + i]), true) AS first FROM m, o),
r AS (SELECT part, filter_order, step, steps[step] AS f, sum(n) FILTER (first IS NULL OR first > step) AS kept, sum(n) FILTER (first = step) AS removed, sum(n) FILTER (fails[1 + steps[step]] AND first < step) AS redundant,
  sum(n) FILTER (fails[1 + steps[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails, sum(good) FILTER (first = step) AS good_lost, sum(toxic) FILTER (first = step) AS toxic_lost
  FROM s, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM r""",
}
