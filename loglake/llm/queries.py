"""The operators applied to the whole test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import (
    decontaminate,
    licenses,
    line_rules,
    near_dups,
    packing,
    periods,
    preferences,
    quality,
    repeats,
    secret_scan,
    spelling,
    token_blocks,
    token_counts,
)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str):
    return table(spark, sf_dir, "documents")


def token_blocks_query(spark, sf_dir: str):
    return token_blocks.encode_documents(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, plain=True
    )


def packing_query(spark, sf_dir: str):
    packed = packing.pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False, plain=True
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def near_dups_query(spark, sf_dir: str):
    found = near_dups.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "class_id", "group_id", "group_docs", "kept")


def decontaminate_query(spark, sf_dir: str):
    return decontaminate.find_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def licenses_query(spark, sf_dir: str):
    found = licenses.scan_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def line_rules_query(spark, sf_dir: str):
    return line_rules.judge(documents(spark, sf_dir)).drop("kept_lines")


def preferences_query(spark, sf_dir: str):
    return preferences.format_pairs(preferences.swapped_pairs(table(spark, sf_dir, "conversations")))


def quality_query(spark, sf_dir: str):
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit_documents(docs, table(spark, sf_dir, "labels")))


def secret_scan_query(spark, sf_dir: str):
    return secret_scan.find_secrets(documents(spark, sf_dir))


def repeats_query(spark, sf_dir: str):
    return repeats.remove_repeats(documents(spark, sf_dir), with_text=False)


def token_counts_query(spark, sf_dir: str):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def spelling_query(spark, sf_dir: str):
    return spelling.group_variants(documents(spark, sf_dir))


def periods_query(spark, sf_dir: str):
    return periods.find_runs(documents(spark, sf_dir), with_text=False, plain=False)


QUERIES = {
    "op1_token_blocks": token_blocks_query,
    "op2_near_dups": near_dups_query,
    "op3_decontaminate": decontaminate_query,
    "op4_licenses": licenses_query,
    "op5_line_rules": line_rules_query,
    "op6_preferences": preferences_query,
    "op7_quality": quality_query,
    "op8_repeats": repeats_query,
    "op9_packing": packing_query,
    "op10_secret_scan": secret_scan_query,
    "op11_token_counts": token_counts_query,
    "op12_spelling": spelling_query,
    "op13_periods": periods_query,
}

REPEATS_SQL = """
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20
), windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS run FROM places
), ranked AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM windows
), removed AS (
    SELECT doc_id, list(DISTINCT j) AS gone FROM (
        SELECT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE k > 1
    ) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    sha256(array_to_string(
        CASE WHEN gone IS NULL THEN w
             ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' '
    )) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

_SIGNS = "".join("\\" + c for c in line_rules.SIGNS)
LINE_RULES_SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM texts
), runs AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3
), keyed AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM runs
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM keyed WHERE k > 1
    ) GROUP BY doc_id
), kept_lines AS (
    SELECT *, list_filter(lines, lambda x: NOT (
        length(regexp_replace(x, '[^{_SIGNS}]', '', 'g')) > length(x) * {line_rules.SIGN_SHARE}
        OR (length(x) > {line_rules.LONG_LINE} AND length(x) - length(replace(x, ' ', '')) >= {line_rules.LONG_LINE} - 1
            AND NOT regexp_matches(x, '{line_rules.MARKS}'))
        OR length(regexp_replace(x, '[^{line_rules.SEPARATOR_SIGNS}]', '', 'g')) >= {line_rules.SEPARATORS}
        OR (length(x) <= {line_rules.SHORT_LINE} AND regexp_matches(lower(x), '{"|".join(line_rules.STOCK_PHRASES)}'))
    )) AS good FROM words
), measured AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS all_chars,
        coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS kept_chars
    FROM kept_lines LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND NOT all_chars - kept_chars > all_chars * {line_rules.LOST_SHARE} AS kept
FROM measured
"""

_RENDER = "array_to_string(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"
_MASK = (
    "array_to_string(list_transform({0}, lambda t: CASE WHEN t.role = 'assistant' "
    "THEN 'm' || (length(t.role) + 5) || ' t' || (length(t.text) + 8) "
    "ELSE 'm' || (length(t.role) + 5 + length(t.text) + 8) END), ' ')"
)
PREFERENCES_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM rows GROUP BY conv_id
), known AS (
    SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM whole
), pairs AS (
    SELECT a.conv_id AS pair_id, a.turns AS chosen,
        CASE WHEN b.conv_id IS NOT NULL
             THEN list_concat(list_append(a.turns[:a.last - 1], {{'role': 'assistant', 'text': b.turns[b.last].text}}), a.turns[a.last + 1:])
             ELSE list_concat(a.turns[:a.last - 1], a.turns[a.last + 1:]) END AS rejected
    FROM known a LEFT JOIN (SELECT * FROM known WHERE last IS NOT NULL) b ON b.conv_id = xor(a.conv_id, 1)
    WHERE a.last IS NOT NULL
), cut AS (
    SELECT *, coalesce(list_min(list_filter(range(1, len(chosen) + 1),
        lambda i: i > len(rejected) OR chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text)) - 1, len(chosen)) AS n
    FROM pairs
)
SELECT pair_id, n AS n_prefix, {_RENDER.format("chosen[:n]")} AS prompt,
    {_RENDER.format("chosen[n + 1:]")} AS chosen, {_MASK.format("chosen[n + 1:]")} AS chosen_mask,
    {_RENDER.format("rejected[n + 1:]")} AS rejected, {_MASK.format("rejected[n + 1:]")} AS rejected_mask
FROM cut
"""

ORACLES: dict = {
    "op5_line_rules": LINE_RULES_SQL,
    "op6_preferences": PREFERENCES_SQL,
    "op8_repeats": REPEATS_SQL,
}
