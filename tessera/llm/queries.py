"""The queries of the training-data operators, one for each operator, and their SQL for DuckDB where SQL can say it.

Each query applies its operator with production parameters to the whole table and derives the digest columns that its
contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arc, bpe, chat, exact_dedup, fill_middle, imatch, line_dedup, mixing, ngram_join, pii, secret_scan, token_alignment, toxicity
from tessera.llm.common import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(name: str) -> Column:
    """Whether labels of a row aren't learnt from."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(~held_out("doc_id")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, from labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts of all documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns, and values that are costly to guess."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), dictionary=secret_scan.vocabulary(ranks()))
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select("doc_id", *[_count(kind) for kind in ("assign", "access", "hex")], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by component of five-word shingle similarity of 0.75 or more."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of all sources by the weights 5, 2, 1 takes of each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each participant."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def ranks(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The content of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return bpe.byte_bpe(table(spark, sf_dir, "documents"), ranks(), pattern(), with_ids=False)


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = imatch.fingerprints(table(spark, sf_dir, "documents"))
    shown = lambda marks: F.lower(F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    return found.select("doc_id", "n_chars", "edited_sha256", shown("marks").alias("fingerprint"), shown("edited_marks").alias("edited_fingerprint"), "near_edited", "near_next")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed patterns, and spans that weak supervision adds."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[_count(kind) for kind in pii.BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as ARC files, converted to WARC files, and read back from these."""
    arcs, warcs = folder(spark, "arc"), folder(spark, "warc")
    arc.write_arc(table(spark, sf_dir, "pages"), arcs, "page_id", "url", "html")
    arc.convert(spark, arcs, warcs)
    read = arc.read_warc(spark, warcs).where(F.col("type").isin("response", "revisit"))
    return read.select(F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_source_id").cast("long").alias("refers_to"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged between its lines, and restored."""
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers grouped by shared byte cuts, with corpus-wide counts of their links."""
    return token_alignment.weigh(table(spark, sf_dir, "documents"), ranks("byte_bpe_50k.json"), ranks("piece_bpe_32k.model"), pattern())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_join": op5_ngram_join,
    "op6_mix_sources": op6_mix_sources,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_imatch": op9_imatch,
    "op10_pii": op10_pii,
    "op11_arc_to_warc": op11_arc_to_warc,
    "op12_fill_middle": op12_fill_middle,
    "op13_token_alignment": op13_token_alignment,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op3_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        line AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM split),
        keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
        common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
                   GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed k LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op6_mix_sources": rf"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
                   / ((length(translate(coalesce(text, ''), '{mixing.JUNK.replace(chr(92), chr(92) * 1)}', '')) + 1.0::DOUBLE) / (length(coalesce(text, '')) + 1.0::DOUBLE)) AS key
            FROM documents),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sums),
        weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM ranked),
        filled AS (
            SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_of_all,
                   CAST(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS sharing
            FROM weighed),
        first AS (SELECT rest_of_all, sharing FROM filled WHERE most * sharing > rest_of_all * weight ORDER BY most / weight, rank LIMIT 1),
        plan AS (
            SELECT f.source, f.source_size,
                   least(f.most::DOUBLE, coalesce((first.rest_of_all * f.weight)::DOUBLE / first.sharing::DOUBLE, f.most::DOUBLE)) AS target
            FROM filled f LEFT JOIN first ON true),
        parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM plan),
        placed AS (
            SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
            FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS taken
        FROM placed""",
    "op7_chat_rotation": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
                          CAST(floor(coalesce(turn, -1) / 512.0) AS BIGINT) AS part FROM conversations),
        p AS (SELECT DISTINCT conv_id AS of, speaker AS participant FROM t WHERE speaker <> 'system'),
        r AS (SELECT t.*, participant, text || '<|end|>' || chr(10) AS body,
                     CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = participant THEN '<|assistant|>'
                          ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
              FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.of),
        o AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant
                     ORDER BY part, turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r)
        SELECT conv_id, participant, part, CAST(min(upto - length(head) - length(body)) AS BIGINT) AS at, count(*) AS n_turns, count(*) FILTER (speaker = participant) AS n_own,
               string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
               coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ','
                        ORDER BY turn NULLS FIRST, speaker, text) FILTER (speaker = participant), '') AS mask
        FROM o GROUP BY conv_id, participant, part""",
    "op11_arc_to_warc": """
        WITH sums AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        named AS (
            SELECT page_id, strlen(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS keeper,
                   array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((CAST('0x' || substr(h, 5 * k // 4 + 1, 2) AS INTEGER) >> CAST(3 - 5 * k % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest
            FROM sums)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM named""",
    "op12_fill_middle": r"""
        WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                            sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        drawn AS (SELECT *, len(units) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS d FROM cut),
        formed AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                          least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b FROM drawn),
        parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
}
