"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), {_FOLD}) AS key FROM line
), shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.first <> k.doc_id AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""



def _share_out(name: str, parents: str, children: str) -> str:
    """CTEs that water-fill the budget of each parent over its children."""
    by = f"PARTITION BY {parents}" if parents else ""
    keys = f"{parents}, {name}" if parents else name
    tight = f"{by} ORDER BY cap / weight, {name}"
    return f"""
{name}_filled AS (
    SELECT *, cap::HUGEINT * rest <= (budget::HUGEINT - before) * weight AS full_up FROM (
        SELECT *, coalesce(sum(cap) OVER ({tight} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(weight) OVER ({tight} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM ({children})
    )
), {name}_shared AS (
    SELECT *, CASE WHEN full_up THEN cap ELSE (remaining::HUGEINT * weight) // open_weight END AS share FROM (
        SELECT *, budget - coalesce(sum(CASE WHEN full_up THEN cap END) OVER ({by}), 0) AS remaining,
               sum(CASE WHEN NOT full_up THEN weight END) OVER ({by}) AS open_weight
        FROM {name}_filled
    )
), {name}_budget AS (
    SELECT {keys}, share + CASE WHEN NOT full_up AND turn <= odd THEN 1 ELSE 0 END AS budget FROM (
        SELECT *, remaining - sum(CASE WHEN NOT full_up THEN share ELSE 0 END) OVER ({by}) AS odd,
               row_number() OVER ({by} ORDER BY full_up, weight DESC, {name}) AS turn
        FROM {name}_shared
    )
)"""


MIXING = f"""
WITH doc AS (
    SELECT doc_id, CASE WHEN length(source) <= 4 THEN 'primary' ELSE 'secondary' END AS domain,
           coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM documents
), leaf AS (
    SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 4 AS cap FROM doc GROUP BY ALL
), {_share_out("domain", "", """
    SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'primary' THEN 3 WHEN 'secondary' THEN 2 ELSE 1 END AS weight,
           (SELECT sum(tokens)::BIGINT * 3 // 5 FROM leaf) AS budget FROM leaf GROUP BY domain""")
}, {_share_out("lang", "domain", """
    SELECT domain, lang, cap, budget,
           CASE domain || '/' || lang WHEN 'primary/en' THEN 4 WHEN 'primary/de' THEN 2 WHEN 'secondary/en' THEN 3 ELSE 1 END AS weight
    FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL) JOIN domain_budget USING (domain)""")
}, {_share_out("source", "domain, lang", """
    SELECT domain, lang, source, cap, budget,
           CASE domain || '/' || lang || '/' || source WHEN 'primary/en/src0' THEN 5 ELSE 1 END AS weight
    FROM leaf JOIN lang_budget USING (domain, lang)""")
}, plan AS (
    SELECT domain, lang, source, (budget // tokens)::BIGINT AS passes, (budget % tokens)::BIGINT AS prefix
    FROM source_budget JOIN leaf USING (domain, lang, source) WHERE budget > 0
), drawn AS (
    SELECT * FROM doc JOIN plan USING (domain, lang, source) WHERE n_tokens > 0
), whole AS (
    SELECT *, unnest(range(0, passes)) AS epoch FROM drawn
), tail AS (
    SELECT *, passes AS epoch, md5('7:' || passes || ':' || doc_id) AS order_key FROM drawn WHERE prefix > 0
), placed AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY order_key, doc_id) - n_tokens AS spent FROM tail
)
SELECT doc_id, domain, lang, source, n_tokens, epoch, n_tokens AS taken, md5('7:' || epoch || ':' || doc_id) AS order_key FROM whole
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, epoch, least(n_tokens, prefix - spent)::BIGINT, order_key FROM placed WHERE spent < prefix
"""

SHARDING = """
WITH arrival AS (
    SELECT doc_id, coalesce(floor(doc_id / 4096), -1)::BIGINT AS run, strlen(coalesce(text, '')) AS size FROM documents
), runs AS (
    SELECT run, 'v1-run' || run AS shard_id, count(*) AS n_rows, sum(size)::BIGINT AS n_bytes,
           length(bin(sum(size)::BIGINT // 65536)) // 2 AS tier, floor(run / 1024)::BIGINT AS part
    FROM arrival GROUP BY run
), small AS (
    SELECT *, count(*) OVER (PARTITION BY tier, part) AS mates,
           (sum(n_bytes) OVER (PARTITION BY tier, part ORDER BY n_bytes, run, shard_id) - n_bytes)::BIGINT // 67108864 AS file
    FROM runs WHERE n_bytes * 2 < 67108864
), placed AS (
    SELECT run, n_rows, n_bytes, tier, CASE WHEN mates >= 4 AND count(*) OVER (PARTITION BY tier, part, file) > 1
           THEN 'v2-tier' || tier || '-part' || part || '-file' || file END AS merged, shard_id
    FROM small
    UNION ALL SELECT run, n_rows, n_bytes, tier, NULL, shard_id FROM runs WHERE n_bytes * 2 >= 67108864
), shard AS (
    SELECT run, coalesce(merged, shard_id) AS shard_id, sum(n_rows) OVER same AS shard_rows, sum(n_bytes) OVER same AS shard_bytes
    FROM placed WINDOW same AS (PARTITION BY coalesce(merged, shard_id))
)
SELECT doc_id, shard_id, (length(bin(shard_bytes::BIGINT // 65536)) // 2)::INTEGER AS shard_tier, shard_rows::BIGINT AS shard_rows,
       shard_bytes::BIGINT AS shard_bytes, 2 AS shard_version
FROM arrival JOIN shard USING (run)
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH item AS (
    SELECT item_id, words, least(len(words), 10) AS t FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0
), iw AS (
    SELECT DISTINCT item_id::VARCHAR AS item, t, array_to_string(words[k:k + t - 1], ' ') AS w
    FROM (SELECT *, unnest(range(1, len(words) - t + 2)) AS k FROM item)
), doc AS (
    SELECT doc_id, {_WORDS} AS words FROM documents
), dw AS (
    SELECT doc_id, t, k, array_to_string(words[k:k + t - 1], ' ') AS w
    FROM (SELECT doc_id, words, t, unnest(range(1, len(words) - t + 2)) AS k FROM doc JOIN (SELECT DISTINCT t FROM iw) ON len(words) >= t)
), hit AS (
    SELECT * FROM dw WHERE (t, w) IN (SELECT (t, w) FROM iw)
), n AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + t)) AS place FROM hit) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hit JOIN iw USING (t, w)) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id)
"""

COLLOCATIONS = f"""
WITH piece AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), total AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM piece GROUP BY lang
), gram AS (
    SELECT lang, m, array_to_string(words[k:k + m - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS k FROM piece, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m)
    GROUP BY ALL HAVING count(*) >= 100
), kept AS (
    SELECT * FROM gram g WHERE m > 1 AND NOT EXISTS (
        SELECT 1 FROM gram o WHERE o.lang = g.lang AND o.m > g.m AND 100 * o.f >= 100 * g.f AND contains(' ' || o.phrase || ' ', ' ' || g.phrase || ' '))
), cut AS (
    SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept)
), scored AS (
    SELECT c.lang, c.phrase, c.f AS a, p.f AS l, q.f AS r, n, (1000::HUGEINT * c.f * n // (p.f::HUGEINT * q.f))::BIGINT AS score, k
    FROM cut c JOIN gram p ON p.lang = c.lang AND p.phrase = c.one JOIN gram q ON q.lang = c.lang AND q.phrase = c.two JOIN total t ON t.lang = c.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {
    "op1_source_mixing": MIXING,
    "op2_line_dedup": LINE_DEDUP,
    "op7_sharding": SHARDING,
    "op8_exact_dedup": EXACT_DEDUP,
    "op12_phrase_collocations": COLLOCATIONS,
    "op13_decontamination": DECONTAMINATION,
}
