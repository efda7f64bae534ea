"""The registered queries of this subpackage: thin digests over the operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import chat, pieces, quality, toxicity
from tessera.llm.common import bounded_batches, table
from tessera.llm.decontaminate import contamination, is_contaminated
from tessera.llm.htmltext import extract_text
from tessera.llm.infill import CODE_POINT, fill_in_middle, restore
from tessera.llm.lines import line_dedup
from tessera.llm.neighbours import nearest
from tessera.llm.shards import shard
from tessera.llm.simhash import fingerprint_components
from tessera.llm.substrings import remove_repeats
from tessera.llm.trie import prefix_trie, rebuilt


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3, min_chars=20)
    return out.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is one event that sets a message: the log of conversations in which nothing was streamed or edited."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # rows of one turn are messages of their own, as nothing says that one replaces another
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", copy.alias("copy"), "role", "text")
    made = chat.format_chats(chat.fold(events))
    # what is under the mask is cut out of the output, and its protection undone
    turns = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("mask")).alias("loss"))
    loss = F.col("loss")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        _sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), _sha256(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_components(table(spark, sf_dir, "documents"), width=3, radius=2)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", _sha256(F.col("text")).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.grade(docs, model, keep_from=2).select("doc_id", "expected_grade", "tail", "keep")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha256(F.array_join("items", ",")).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


#: Bytes of text that a shard holds at most.
SHARD_BYTES = 8 << 20


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels whose id's crc32 is divisible by five are held out; a null id counts as the empty text, so it is."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bounded_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held))
    return toxicity.rate(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and forms come from four numbers of each id's hash; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25))
    form = F.when(h3 % 100 >= 90, "plain").when(h4 % 100 < 20, "spm").otherwise("psm")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs, lambda n: (h1 % (n + 1), h2 % (n + 1)), form, CODE_POINT)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pieces": op2_pieces,
    "op3_chat": op3_chat,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_substrings": op6_substrings,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_shards": op9_shards,
    "op10_neighbours": op10_neighbours,
    "op11_toxicity": op11_toxicity,
    "op12_infill": op12_infill,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line, len(lines) AS n_lines
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
        ), k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), r AS (
            SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), f AS (
            SELECT k.*, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key
        )
        SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id
    """,
    "op3_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e AS (
            SELECT *, '<s>[INST]' || regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')
                   || '[/INST]' || regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') || '</s>' AS shown
            FROM c
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(shown))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op8_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), iw AS (
            SELECT DISTINCT item_id, ws[s : s + least(13, len(ws)) - 1] AS w, least(13, len(ws)) AS n
            FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s FROM i WHERE len(ws) > 0)
        ), sizes AS (SELECT DISTINCT n FROM iw
        ), dw AS (
            SELECT doc_id, s, n, ws[s : s + n - 1] AS w
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)
        ), m AS (
            SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w
        ), h AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
        ), t AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id
        )
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
    """,
    "op9_shards": r"""
        WITH r AS (
            SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS row_bytes,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS h FROM documents
        ), g AS (
            SELECT r, doc_id, row_bytes, depth::INTEGER AS depth, h >> (60 - depth) AS prefix, count(*) OVER w AS shard_rows, sum(row_bytes) OVER w AS shard_bytes
            FROM (SELECT r.*, unnest(range(0, 61)) AS depth FROM r) WINDOW w AS (PARTITION BY depth, h >> (60 - depth))
        ), f AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY depth) AS k FROM g WHERE shard_bytes <= 8388608 OR shard_rows = 1
        )
        SELECT doc_id, row_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_rows::BIGINT AS shard_rows, shard_bytes::BIGINT AS shard_bytes
        FROM f WHERE k = 1
    """,
    "op12_infill": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
        ), h AS (
            SELECT doc_id, x, length(x)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
        ), c AS (
            SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), p AS (
            SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1, n - b) AS suf FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(x) AS restored_sha256
        FROM p
    """,
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                   {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, list(m ORDER BY i) AS own FROM t GROUP BY conv_id
        ), crc AS (
            -- the table of CRC-32, then a byte at a time
            SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM (SELECT unnest(range(256)) AS b))
        ), h AS (
            SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
                   lambda x, y: xor(tab[xor(x % 256, y) + 1], x // 256))) % 6 AS h
            FROM c, crc
        ), r AS (
            SELECT h.conv_id, coalesce(b.own, [])[1 : h.h] || h.own[h.h + 1 :] AS ms FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100
        ), p AS (
            SELECT conv_id, ms, unnest(range(0, len(ms) + 1)) AS depth FROM r
        ), n AS (
            SELECT depth, ms[1 : depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(ms)) = depth AS leaf,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ms) = depth), '')) AS ends_sha256
            FROM p GROUP BY 1, 2
        ), u AS (
            SELECT a.conv_id, a.depth, count(*) FILTER (WHERE d.leaf) AS n_leaves, sum(CASE WHEN d.depth > 0 THEN (d.n_convs - 1) * length(d.path[-1].t) ELSE 0 END) AS saved_tokens, count(*) FILTER (WHERE d.depth = a.depth + 1) AS n_children
            FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM n) d JOIN n a ON a.depth = d.up AND a.path = d.path[1 : d.up] GROUP BY 1, 2
        )
        SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN u ON n.conv_id = u.conv_id AND n.depth = u.depth LEFT JOIN n q ON q.depth = n.depth - 1 AND q.path = n.path[1 : n.depth - 1] AND n.depth > 0
    """,
}
