"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

# words of both tables; an item's runs are of five words or, if it has fewer, of all of them; a document's of those sizes
_LEAKS = """
        WITH words AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
                       UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
             w AS (SELECT side, id, r, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'),
                                                   lambda x: x <> '') AS w FROM words),
             sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE side = 'i' AND len(w) > 0),
             s AS (SELECT DISTINCT side, id, r, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)),
                            lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
                   FROM w, sizes WHERE len(w) >= k AND (side = 'd' OR k = least(len(w), 5))),
             i AS (SELECT DISTINCT id, s FROM s WHERE side = 'i'),
             n AS (SELECT id, count(*) AS n FROM i GROUP BY id),
             p AS (SELECT d.id AS doc_id, d.r, i.id AS item_id, count(*) AS k FROM i JOIN s d ON d.s = i.s
                   WHERE d.side = 'd' GROUP BY ALL),
             b AS (SELECT doc_id, item_id, max(k) AS k FROM p GROUP BY ALL)
        SELECT doc_id, item_id, k AS n_shared, n AS n_shingles, k / n AS containment
        FROM b JOIN n ON n.id = item_id WHERE k >= 0.8 * n
"""

# SHA-1 in base32: five hexadecimal digits are four digits of five bits
_BASE32 = """
    list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([32768, 1024, 32, 1], lambda p:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) // p) % 32 AS BIGINT) + 1, 1)),
        lambda a, b: a || b)), lambda a, b: a || b)
"""

_FEATURES = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')"""

# CRC-32 by half bytes: the table of 16 entries follows from the polynomial; the low half of each byte comes first
_CRC_TABLE = """list_transform(range(16), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0],
                   lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
_CRC32 = f"""xor(4294967295, list_reduce(
                 list_prepend(4294967295, list_transform(range(1, strlen(w) * 2 + 1),
                     lambda j: CAST('0x' || hex(encode(w))[CASE WHEN j % 2 = 1 THEN j + 1 ELSE j - 1 END] AS BIGINT))),
                 lambda a, x: xor(a // 16, ({_CRC_TABLE})[xor(a, x) % 16 + 1])))"""

ORACLES = {
    "op4_benchmark_decontamination": _LEAKS,
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
                   FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(n) OVER w AS top,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = top AS kept, text_sha256 FROM g
    """,
    "op9_warc": f"""
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM t)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM g
    """,
    # marks: 3 characters begin a conversation, [INST] [/INST], [SYS] [/SYS], </s>, [MSG] between merged turns, and one
    # backslash more for each mark inside a text
    "op11_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
             e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*(?:/s>|s>))', '<\\\1', 'g'),
                                            '\[(\\*(?:/?(?:INST|SYS|ROLE)\]|MSG\]))', '[\\\1', 'g') AS escaped,
                          lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
                   FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(length(escaped) + CASE WHEN role = before THEN 5
                                                   WHEN role = 'user' THEN 13 WHEN role = 'system' THEN 11
                                                   WHEN role = 'assistant' THEN 4
                                                   ELSE 18 + length(role) END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op12_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                          sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
             h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
                          CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM t),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                                    OR h3 % 100 >= 90 THEN 'plain'
                               WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
             s AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
                          coalesce(array_to_string(u[b + 1:], ''), '') AS q FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m
                                ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM s
    """,
    "op13_importance_resampling": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_FEATURES} AS w FROM documents),
             b AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
             dw AS (SELECT r, unnest(w) AS w FROM d),
             v AS (SELECT w, {_CRC32} % 10000 AS k FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b))),
             s AS (SELECT k, count(*) AS n FROM dw JOIN v USING (w) GROUP BY k),
             t AS (SELECT k, count(*) AS n FROM b JOIN v USING (w) GROUP BY k),
             g AS (SELECT s.k, CAST(floor(1000 * ln(
                              (CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
                              / ((CAST(s.n AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain
                   FROM s LEFT JOIN t USING (k)),
             m AS (SELECT r, sum(gain) AS total, count(*) AS n FROM dw JOIN v USING (w) JOIN g USING (k) GROUP BY r),
             x AS (SELECT doc_id, len(w) AS n_features,
                          CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                          CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE))) AS BIGINT) AS noise
                   FROM d LEFT JOIN m USING (r)),
             o AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20
                          ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place FROM x)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100
                    THEN place END AS rank
        FROM o
    """,
}
