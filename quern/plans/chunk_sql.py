"""The chunkers as DuckDB SQL: splitting as recursion over spans, joining and packing as recursion over places.

Each function returns CTEs. A text is known by ``k``; spans are (k, pos, txt) with pos from 1, and
where offsets are kept also a and b. CTE names get a prefix, so that one statement may use a
function several times.
"""

from __future__ import annotations

from quern.functions import text as T
from quern.operators.chunking import SEPARATORS, ChunkerConfig
from quern.plans.common import BLANKS

_GAP = "chr(10) || chr(10)"
_HEADING = r"^(#{1,6})\s+(.+?)$"
_OPENING = r"^(#{1,6})\s+(.+?)(?:\n|$)"


def literal(text: str) -> str:
    quoted = text.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"('{quoted}')"


def estimate(n: str) -> str:
    return f"(CASE WHEN ({n}) = 0 THEN 0 ELSE greatest(1, ({n}) // 4) END)"


def tidy(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, ' +', ' ', 'g'), '\n{{3,}}', {_GAP}, 'g'), {BLANKS})"


def sentences(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    variant = f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return f"lower(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def chunk_id(document: str, index: str, text: str) -> str:
    return uuid5(T.CHUNK_NAMESPACE, f"{document} || ':' || {index} || ':' || sha256({text})")


def narrowed(p: str, source: str, config: ChunkerConfig) -> str:
    """``p_span``: the pieces of the tidied texts of ``source`` (k, t), cut at the first separators that occur, again and again."""
    size, n = config.chunk_size * 4, len(config.separators)
    seps = "[" + ", ".join(map(literal, config.separators)) + "]"
    return f"""{p}_node AS (
        SELECT k, 0::BIGINT AS a, {tidy('t')} AS txt, 1 AS sep FROM {source}
        UNION ALL
        SELECT k, x.a, x.txt, sep FROM (
            SELECT k, unnest(list_transform(parts, lambda y, i: {{'txt': y, 'a': a + coalesce(list_sum(list_transform(parts[:i - 1], lambda z: length(z))), 0)::BIGINT}})) AS x, sep FROM (
                SELECT k, a, coalesce(j, 98) + 1 AS sep,
                       CASE WHEN j IS NULL THEN [left(txt, {size}), substr(txt, {size + 1})]
                            ELSE list_filter(list_transform(string_split(txt, {seps}[j]), lambda y, i: CASE WHEN i = 1 THEN y ELSE {seps}[j] || y END), lambda y: y <> '') END AS parts
                FROM (SELECT *, list_min(list_filter(range(sep, {n + 1}), lambda i: contains(txt, {seps}[i]))) AS j FROM {p}_node
                      WHERE length(txt) > {size} AND (sep = 99 OR trim(txt, {BLANKS}) <> '')))
        )
    ), {p}_span AS MATERIALIZED (
        SELECT k, row_number() OVER (PARTITION BY k ORDER BY a) AS pos, txt, a, a + length(txt) AS b FROM {p}_node WHERE length(txt) <= {size} AND (sep = 99 OR trim(txt, {BLANKS}) <> ''))"""


def joined(p: str, source: str, low: int, high: int) -> str:
    """``p_join``: neighbours joined left to right while one is small and both fit."""
    n = "length(s.txt)"
    fits = rf"({estimate('w.n')} < {low} OR ({estimate(n)} < {low} AND NOT regexp_matches(ltrim(s.txt, {BLANKS}), '^#{{1,6}}\s+'))) AND {estimate(f'w.n + 2 + {n}')} <= {high}"
    return f"""{p}_walk AS (
        SELECT k, pos, 1::BIGINT AS grp, length(txt)::BIGINT AS n FROM {source} WHERE pos = 1
        UNION ALL SELECT s.k, s.pos, CASE WHEN {fits} THEN w.grp ELSE w.grp + 1 END, CASE WHEN {fits} THEN w.n + 2 + {n} ELSE {n} END FROM {p}_walk w JOIN {source} s ON s.k = w.k AND s.pos = w.pos + 1
    ), {p}_join AS MATERIALIZED (SELECT k, grp AS pos, string_agg(txt, {_GAP} ORDER BY pos) AS txt, min(a) AS a, max(b) AS b FROM {p}_walk JOIN {source} USING (k, pos) GROUP BY k, grp)"""


def _last_units(units: str, room: int, joint: str) -> str:
    """The longest run of last units that fits, one at least."""
    first = f"list_min(list_filter(range(1, len({units}) + 1), lambda i: list_sum(list_transform({units}[i:], lambda x: length(x) + 1)) - 1 <= {room}))"
    return f"array_to_string({units}[coalesce({first}, len({units})):], {joint})"


def overlapped(p: str, source: str, tokens: int, skip: bool = False) -> str:
    """``p_chunk`` (k, pos, span, t, a, b): each span with the tail of the one before it."""
    room = tokens * 4
    there = "starts_with(txt, left(tail, 20))" if skip else "false"
    return f"""{p}_before AS (SELECT *, lag(txt) OVER (PARTITION BY k ORDER BY pos) AS before FROM {source}),
    {p}_units AS (SELECT *, {sentences(f'right(before, {2 * room})')} AS u, string_split(right(before, {2 * room}), chr(10)) AS l, right(before, {room}) AS r FROM {p}_before),
    {p}_tail AS (SELECT *, CASE WHEN {room} = 0 OR coalesce(before, '') = '' THEN '' WHEN length(before) <= {room} THEN before WHEN len(u) > 1 THEN {_last_units('u', room, "' '")} WHEN len(l) > 1 THEN {_last_units('l', room, 'chr(10)')}
        WHEN instr(r, ' ') - 1 > 0 AND instr(r, ' ') - 1 < length(r) // 3 THEN substr(r, instr(r, ' ') + 1) ELSE r END AS tail FROM {p}_units),
    {p}_chunk AS MATERIALIZED (SELECT k, pos, txt AS span, CASE WHEN tail <> '' AND NOT {there} THEN tail || {_GAP} || txt ELSE txt END AS t, a, b FROM {p}_tail)"""


def recursive(p: str, source: str, config: ChunkerConfig) -> str:
    return ", ".join([narrowed(p, source, config), joined(p, f"{p}_span", config.min_chunk_size, config.max_chunk_size), overlapped(p, f"{p}_join", config.chunk_overlap)])


def structured(p: str, source: str, config: ChunkerConfig) -> str:
    """``p_chunk`` as above (no offsets), of sections by headings, long ones by paragraphs, very long paragraphs by sentences."""
    size, most = config.chunk_size * 4, config.max_chunk_size * 4
    return rf"""{p}_line AS (SELECT k, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT k, string_split({tidy('t')}, chr(10)) AS l FROM {source})),
    {p}_head AS (SELECT *, regexp_matches(line, '{_HEADING}') AS head FROM {p}_line),
    {p}_number AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY k ORDER BY i) AS sec FROM {p}_head),
    {p}_section AS (SELECT k, sec, coalesce(max(CASE WHEN head AND trim(regexp_extract(line, '{_HEADING}', 2), {BLANKS}) <> '' THEN regexp_extract(line, '{_HEADING}', 1) || ' ' || trim(regexp_extract(line, '{_HEADING}', 2), {BLANKS}) || {_GAP} END), '') AS prefix,
        trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), {BLANKS}) AS content FROM {p}_number GROUP BY k, sec),
    {p}_long AS MATERIALIZED (SELECT * FROM {p}_section WHERE length(prefix) + length(content) > {size}),
    {p}_block AS (SELECT k, sec, prefix, unnest(f) AS block, generate_subscripts(f, 1) AS f FROM (SELECT *, string_split(regexp_replace(content, '(```[\s\S]*?```|~~~[\s\S]*?~~~)', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS f FROM {p}_long)),
    {p}_part AS (SELECT k, sec, prefix, f, unnest(g) AS txt, generate_subscripts(g, 1) AS g FROM (
        SELECT *, CASE WHEN f % 2 = 0 THEN [block] ELSE list_filter(list_transform(string_split(block, {_GAP}), lambda x: trim(x, {BLANKS})), lambda x: x <> '') END AS g FROM {p}_block)),
    {p}_unit AS MATERIALIZED (SELECT k, sec, prefix, txt, row_number() OVER (PARTITION BY k, sec ORDER BY f, g) AS u, length(prefix) + length(txt) + 2 > {most} AS big FROM {p}_part),
    {p}_fill AS (
        SELECT k, sec, prefix, 0::BIGINT AS u, 0 AS grp, length(prefix)::BIGINT AS n, false AS big FROM {p}_long
        UNION ALL SELECT s.k, s.sec, s.prefix, s.u, CASE WHEN w.n + length(s.txt) + 2 <= {size} THEN w.grp ELSE w.grp + 1 END,
            CASE WHEN w.n + length(s.txt) + 2 <= {size} THEN w.n + length(s.txt) + 2 WHEN s.big THEN length(s.prefix) ELSE length(s.prefix) + length(s.txt) + 2 END, s.big AND w.n + length(s.txt) + 2 > {size}
        FROM {p}_fill w JOIN {p}_unit s ON s.k = w.k AND s.sec = w.sec AND s.u = w.u + 1
    ), {p}_said AS MATERIALIZED (SELECT k, sec, prefix, grp, u, unnest(q) AS said, generate_subscripts(q, 1) AS s FROM (SELECT f.*, {sentences('x.txt')} AS q FROM {p}_fill f JOIN {p}_unit x USING (k, sec, u) WHERE f.big)),
    {p}_say AS (
        SELECT k, sec, u, s, 1 AS part, (length(prefix) + length(said) + 1)::BIGINT AS n FROM {p}_said WHERE s = 1
        UNION ALL SELECT x.k, x.sec, x.u, x.s, CASE WHEN w.n + length(x.said) + 1 <= {size} THEN w.part ELSE w.part + 1 END, CASE WHEN w.n + length(x.said) + 1 <= {size} THEN w.n ELSE length(x.prefix) END + length(x.said) + 1
        FROM {p}_say w JOIN {p}_said x ON x.k = w.k AND x.sec = w.sec AND x.u = w.u AND x.s = w.s + 1
    ), {p}_text AS (
        SELECT k, sec, 0 AS o, 0 AS part, prefix || content AS txt FROM {p}_section WHERE length(prefix) + length(content) <= {size}
        UNION ALL SELECT f.k, f.sec, 2 * f.grp, 0, trim(any_value(f.prefix) || coalesce(string_agg(CASE WHEN NOT f.big THEN x.txt || {_GAP} END, '' ORDER BY f.u), ''), {BLANKS}) FROM {p}_fill f LEFT JOIN {p}_unit x USING (k, sec, u) GROUP BY f.k, f.sec, f.grp
        UNION ALL SELECT k, sec, 2 * any_value(grp) - 1, part, trim(any_value(prefix) || string_agg(said || ' ', '' ORDER BY s), {BLANKS}) FROM {p}_say JOIN {p}_said USING (k, sec, u, s) GROUP BY k, sec, u, part
    ), {p}_span AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY sec, o, part) AS pos, txt, 0 AS a, 0 AS b FROM {p}_text WHERE txt <> ''),
    {joined(p, f'{p}_span', config.min_chunk_size, config.max_chunk_size)}, {overlapped(p, f'{p}_join', config.chunk_overlap, True)}"""


def opening(span: str) -> str:
    return rf"CASE WHEN regexp_matches({span}, '{_OPENING}') THEN trim(regexp_extract({span}, '{_OPENING}', 2), {BLANKS}) END"


def packed_sentences(p: str, source: str, size: int) -> str:
    """``p_join``: sentences (``p_sentence``) packed to the chunk size without a look at their meaning."""
    return f"""{p}_fold AS (
        SELECT k, pos, 1::BIGINT AS grp, ({estimate('length(txt)')})::BIGINT AS n FROM {p}_sentence WHERE pos = 1
        UNION ALL SELECT s.k, s.pos, CASE WHEN w.n > 0 AND w.n + {estimate('length(s.txt)')} > {size} THEN w.grp + 1 ELSE w.grp END, CASE WHEN w.n > 0 AND w.n + {estimate('length(s.txt)')} > {size} THEN 0 ELSE w.n END + {estimate('length(s.txt)')}
        FROM {p}_fold w JOIN {p}_sentence s ON s.k = w.k AND s.pos = w.pos + 1
    ), {p}_join AS MATERIALIZED (SELECT k, grp AS pos, string_agg(txt, ' ' ORDER BY pos) AS txt, 0 AS a, 0 AS b FROM {p}_fold JOIN {p}_sentence USING (k, pos) GROUP BY k, grp)"""


def split_sentences(p: str, source: str) -> str:
    """``p_sentence``: sentences, headings and list items."""
    marked = f"regexp_replace(regexp_replace(regexp_replace({tidy('t')}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '\\n(#{{1,6}}\\s|[-*]\\s|\\d+\\.\\s)', chr(1) || '\\1', 'g'), '\\n\\n', chr(1), 'g')"
    return f"""{p}_piece AS (SELECT k, unnest(q) AS txt, generate_subscripts(q, 1) AS i FROM (SELECT k, list_filter(list_transform(string_split({marked}, chr(1)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS q FROM {source})),
    {p}_sentence AS MATERIALIZED (SELECT k, i::BIGINT AS pos, txt FROM {p}_piece)"""


def by_meaning(p: str, threshold: float, apart: int, vector: str) -> str:
    """``p_topic``: sentences grouped between breaks, where ``vector`` (of ``txt``) turns from one sentence to the next; texts of fewer than three sentences whole."""
    return f"""{p}_vector AS (SELECT k, pos, txt, {vector} AS e, count(*) OVER (PARTITION BY k) AS m FROM {p}_sentence),
    {p}_turn AS MATERIALIZED (SELECT k, pos, txt, m, pos < m AND m >= 3 AND coalesce(nullif(list_cosine_similarity(e, lead(e) OVER (PARTITION BY k ORDER BY pos)), 'nan'::DOUBLE), 0) < {threshold} AS low FROM {p}_vector),
    {p}_fold AS (
        SELECT k, pos, 1::BIGINT AS grp, CASE WHEN low AND pos >= {apart} THEN pos ELSE 0 END AS cut FROM {p}_turn WHERE pos = 1
        UNION ALL SELECT s.k, s.pos, CASE WHEN w.cut = w.pos THEN w.grp + 1 ELSE w.grp END, CASE WHEN s.low AND s.pos - w.cut >= {apart} THEN s.pos ELSE w.cut END FROM {p}_fold w JOIN {p}_turn s ON s.k = w.k AND s.pos = w.pos + 1
    ), {p}_topic AS MATERIALIZED (SELECT k, grp AS pos, string_agg(txt, ' ' ORDER BY pos) AS txt, 0 AS a, 0 AS b FROM {p}_fold JOIN {p}_turn USING (k, pos) GROUP BY k, grp)"""


def merged_comments(p: str, source: str, cap: int) -> str:
    """``p_comment`` (thread, pos, author, first_at, body): an author's consecutive comments joined while they stay within the cap; ``source`` is (thread, o, author, first_at, body)."""
    fits = f"w.author = s.author AND w.n + length(s.body) + 10 <= {cap}"
    return f"""{p}_turns AS MATERIALIZED (SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY o, author, body) AS i, author, first_at, body FROM {source}),
    {p}_run AS (
        SELECT thread, i, author, 1::BIGINT AS pos, length(body)::BIGINT AS n FROM {p}_turns WHERE i = 1
        UNION ALL SELECT s.thread, s.i, s.author, CASE WHEN {fits} THEN w.pos ELSE w.pos + 1 END, CASE WHEN {fits} THEN w.n + 7 ELSE 0 END + length(s.body) FROM {p}_run w JOIN {p}_turns s ON s.thread = w.thread AND s.i = w.i + 1
    ), {p}_comment AS MATERIALIZED (SELECT r.thread, r.pos, any_value(r.author) AS author, arg_min(t.first_at, r.i) AS first_at, string_agg(t.body, {_GAP} || '---' || {_GAP} ORDER BY r.i) AS body FROM {p}_run r JOIN {p}_turns t USING (thread, i) GROUP BY r.thread, r.pos)"""


__all__ = ["SEPARATORS"]
