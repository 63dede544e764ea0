"""The queries of this subpackage, with production parameters, and their SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import (
    conversations,
    credentials,
    jaccard_join,
    language_id,
    line_dedup,
    metric_join,
    mixing,
    packing,
    pii,
    resampling,
    substring_dedup,
    token_records,
    top_k,
)
from starloom.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]

WEIGHTS, TOTAL_SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 7
SIMILAR = jaccard_join.Similarity(width=3, under=90, over=100)
LINE_EDITS, LINE_CHARS = 2, 20
NEIGHBOURS, NEAR_COSINE = 10, 0.98
CAPACITY = 2048
PASSAGE_WORDS = 20
FEATURE_WORDS, BUCKETS, SAMPLE_SEED, SAMPLE_WORDS, SAMPLE_PERCENT = 1, 10_000, 2024, 20, 10


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.group_similar(docs, Scratch(spark, "op1"), SIMILAR)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    docs = table(spark, sf_dir, "documents")
    token_records.write_records(docs, scratch.path("records"), tokenizer_path(), end_id=1)
    index = token_records.write_index(spark, scratch.path("records"), scratch.path("index"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    docs = table(spark, sf_dir, "documents")
    sizes = mixing.numbered(docs.select("doc_id", "source", mixing.n_words("text").alias("size")))
    sizes = scratch.keep(sizes, "sizes")
    targets = mixing.source_targets(sizes, WEIGHTS, TOTAL_SHARE, MAX_EPOCHS)
    rates = scratch.keep(mixing.rates(sizes, targets, SEED), "rates")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    mixed = mixing.with_copies(sizes, rates, SEED)
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source")


OP3_SQL = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
               WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
    FROM d GROUP BY source),
c AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
           sum(w) OVER () AS all_w FROM s),
f AS (
    SELECT *, w * (total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) >= cap AS full_
    FROM c
    WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT source, source_size,
           CASE WHEN full_ THEN cap
                ELSE w * (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ())
                     / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target
    FROM f),
p AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
           coalesce(sum(d.size) OVER (
               PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
           (floor(target / source_size)
            + (before + size / 2.0::DOUBLE <= target - floor(target / source_size) * source_size)::INT) * size
       END::BIGINT AS taken, source
FROM p
"""


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_k.usable(table(spark, sf_dir, "embeddings"), "embedding").filter("vec_id IS NOT NULL")
    rows = top_k.of_one_length(rows, "embedding")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    vectors = rows.select("vec_id", whole.alias("v"))
    return top_k.top_k(vectors, vectors.filter("vec_id % 100 = 0"), Scratch(spark, "op4"), NEIGHBOURS)


OP4_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {NEIGHBOURS}
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedupe_lines(docs, Scratch(spark, "op5"), LINE_EDITS, LINE_CHARS, short_repeats=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.group_near(table(spark, sf_dir, "embeddings"), Scratch(spark, "op6"), NEAR_COSINE)


OP6_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= {NEAR_COSINE}),
r AS (
    SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id,
       e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    docs = table(spark, sf_dir, "documents")
    cut = scratch.keep(packing.pieces(docs, tokenizer_path(), end_id=0, capacity=CAPACITY), "pieces")
    return packing.pack(spark, cut, CAPACITY)


def _span_digests(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """doc_id and spans as counts of the base kinds, a digest of these spans, and a list of all."""
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    of_kinds = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(listed(of_kinds(*base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.detect(table(spark, sf_dir, "documents")), pii.BASE)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.dedupe_passages(docs, Scratch(spark, "op9"), PASSAGE_WORDS).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", "removed"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out("doc_id")))
    predicted = language_id.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.detect(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))
    return _span_digests(found, credentials.BASE)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = resampling.resample(
        docs, target, Scratch(spark, "op12"), FEATURE_WORDS, BUCKETS, SAMPLE_SEED, SAMPLE_WORDS, SAMPLE_PERCENT
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of every distinct word by its table of 256 entries, which the first list makes of the polynomial.
OP12_SQL = f"""
WITH crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {resampling.POLYNOMIAL}) ELSE a >> 1 END)) AS t),
d AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents),
w AS MATERIALIZED (SELECT row, unnest(words) AS word FROM d),
v AS MATERIALIZED (
    SELECT unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark),
k AS MATERIALIZED (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))),
            lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
        lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket
    FROM (SELECT word FROM w UNION SELECT word FROM v), crc),
s AS (SELECT bucket, count(*) AS n FROM w JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM v JOIN k USING (word) GROUP BY bucket),
g AS (
    SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + {BUCKETS})::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM v) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM (SELECT unnest(range({BUCKETS})) AS bucket) b
    LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
m AS (
    SELECT w.row, floor(sum(g.gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY w.row),
r AS (
    SELECT d.row, d.doc_id, len(d.words)::BIGINT AS n_features, coalesce(m.weight, 0) AS weight,
        coalesce(m.weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('{SAMPLE_SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN m ON m.row = d.row),
e AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
    FROM r WHERE n_features >= {SAMPLE_WORDS})
SELECT r.doc_id, r.n_features, r.weight, r.score, CASE WHEN e.rank <= {SAMPLE_PERCENT} * e.n // 100 THEN e.rank END AS rank
FROM r LEFT JOIN e ON e.row = r.row
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults by the CRC of their conversation and turn: conv_id, turn, role, text."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("fault"),
    )
    text = F.expr("CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END")
    copies = F.explode(F.expr("CASE fault WHEN 0 THEN array() WHEN 3 THEN array(1, 2) ELSE array(1) END"))
    role = F.expr("CASE fault WHEN 4 THEN 'user' ELSE role END")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(turns), Scratch(spark, "op13")).conversations
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _op13_sql() -> str:
    """Row after row, per state of the grammar the cheapest and least (cost, audit, repaired text)."""

    def after(state: str, cost: str, audit: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{audit}', 't': {state}.t || {line}}}"

    def best(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x.c < 1000000000))"

    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    line, text = "(chr(10) || d.role || ':' || d.text)", "d.text"
    cut = "CASE WHEN d.cut THEN 5 ELSE 0 END"
    go = {s: f"CASE WHEN NOT d.gone THEN {{o}} ELSE {never} END" for s in "sua"}

    def to(letter: str, state: str, insert: str | None = None) -> str:
        """From a state to a row as this letter; with a row of the other role inserted before."""
        name = {"u": "user", "a": "assistant"}[letter]
        cost, audit = ("0", "") if insert is None else ("5", "I")
        inserted = "''" if insert is None else f"(chr(10) || '{insert}:')"
        keep = after(state, f"{cost} + {cut}", audit + "K", f"{inserted} || {line}")
        rerole = after(state, f"{cost} + 1 + {cut}", audit + "R", f"{inserted} || chr(10) || '{name}:' || {text}")
        return go[letter].replace("{o}", f"CASE WHEN d.role[1] = '{letter}' THEN {keep} ELSE {rerole} END")

    delete = {s: after(f"r.{s}", "2", "D", "''") for s in ("n", "s", "u", "a")}
    keep_s = go["s"].replace("{o}", f"CASE WHEN d.role[1] = 's' THEN {after('r.n', cut, 'K', line)} ELSE {never} END")
    step = {
        "n": delete["n"],
        "s": best(delete["s"], keep_s, never.replace("1000000000", "999999999")),
        "u": best(delete["u"], to("u", "r.n"), to("u", "r.s"), to("u", "r.a"), to("u", "r.u", "assistant")),
        "a": best(delete["a"], to("a", "r.u"), to("a", "r.n", "user"), to("a", "r.s", "user"), to("a", "r.a", "user"),
                  never.replace("1000000000", "999999999")),
    }
    step["u"] = step["u"].replace("list_min(list_filter([", f"list_min(list_filter([{never.replace('1000000000', '999999999')}, ", 1)
    ends = best(
        "n", "a", "{'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}",
        "{'c': s.c + 10, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}",
    )
    start = never.replace("1000000000", "999999999")
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {resampling.POLYNOMIAL}) ELSE a >> 1 END)) AS t),
k AS MATERIALIZED (
    SELECT conv_id, turn, role, text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations),
f AS MATERIALIZED (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(key)), lambda i: ord(key[i + 1])::BIGINT)),
        lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 20 AS fault
    FROM k, crc),
m AS MATERIALIZED (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM f WHERE fault != 0),
o AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM m),
q AS MATERIALIZED (
    SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        body[-1] NOT IN ('.', '!', '?') AS ends_badly,
        role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS two
    FROM o),
d AS MATERIALIZED (
    SELECT *, blank OR again AS gone, NOT blank AND NOT again AND ends_badly AS cut FROM q),
r AS (
    SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, {start} AS s, {start} AS u, {start} AS a
    FROM (SELECT DISTINCT conv_id FROM d)
    UNION ALL
    SELECT r.conv_id, d.pos, {step["n"]}, {step["s"]}, {step["u"]}, {step["a"]}
    FROM r JOIN d ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND d.pos = r.pos + 1),
e AS (
    SELECT conv_id, {ends} AS x FROM r
    QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)),
g AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
        count_if(NOT blank AND again) AS duplicate, count_if(cut) AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM d GROUP BY conv_id),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank,
    coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
    coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(e.x.c, 0)::BIGINT AS cost, coalesce(e.x.a, '') AS audit,
    sha256(coalesce(substr(e.x.t, 2), '')) AS repaired_sha256
FROM i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_records": op2_token_records,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_personal_data": op8_personal_data,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_secret_scan": op11_secret_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": OP3_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
