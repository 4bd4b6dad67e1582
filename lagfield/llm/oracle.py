"""DuckDB SQL with the same result as a query, where SQL can express it."""

from lagfield.llm import quality

BLANKS = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{BLANKS}'), lambda w: w <> '')"


def solid_length(text: str) -> str:
    return f"length(regexp_replace({text}, '{BLANKS}', '', 'g'))"


def line_fails(line: str) -> str:
    ws = words(line)
    listed = ", ".join(f"'{p}'" for p in quality.BOILERPLATE)
    phrases = f"coalesce(list_sum(list_transform(list_filter([{listed}], lambda p: contains(lower({line}), p)), lambda p: length(p))), 0)"
    return rf"""(len({ws}) > 0 AND (
        100 * len(list_filter({ws}, lambda w: regexp_matches(w, '[#*$%&|<>!?]{{2}}$'))) > 30 * len({ws})
        OR NOT regexp_matches({line}, '[\p{{L}}\p{{N}}]')
        OR 100 * len(list_filter({ws}, lambda w: w IN ('|', '>', '<', '»', '«', '·', '•', '/', '::'))) > 20 * len({ws})
        OR 100 * {phrases} > 20 * length({line})))"""


def line_short(line: str) -> str:
    ws = words(line)
    return rf"""(len({ws}) BETWEEN 1 AND 3 AND NOT regexp_matches({line}, '[.!?:;,"'')\]…][ \t\n\v\f\r]*$'))"""


IN_RUN = """((i > 2 AND shorts[i - 2] AND shorts[i - 1]) OR (i > 1 AND shorts[i - 1] AND coalesce(shorts[i + 1], false))
        OR (coalesce(shorts[i + 1], false) AND coalesce(shorts[i + 2], false)))"""


def quality_ctes(table: str) -> str:
    """CTEs up to ``judged``: every row of ``table`` with its measures and verdict."""
    return rf"""
    texts AS (SELECT *, coalesce(text, '') AS t, {words("text")} AS ws FROM {table}),
    placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
    triples AS (SELECT doc_id, i, w AS a, lead(w) OVER d AS b, lead(w, 2) OVER d AS c
                FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM triples WHERE c IS NOT NULL),
    repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, (VALUES (0), (1), (2)) x(k)
                WHERE n > 1 GROUP BY doc_id),
    sole AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SOLID}')) AS solid,
                    string_split(t, chr(10)) AS lines FROM texts),
    judged_lines AS (SELECT *, list_transform(lines, lambda x: {line_fails("x")}) AS fails,
                            list_transform(lines, lambda x: {line_short("x")}) AS shorts FROM sole),
    cleaned AS (SELECT *, list_filter(lines, lambda x, i: NOT (fails[i] OR (shorts[i] AND {IN_RUN}))) AS good FROM judged_lines),
    measured AS (
        SELECT c.*, len(ws)::BIGINT AS n_words, {solid_length("t")}::BIGINT AS word_chars,
               (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
               (len(solid) - len(list_distinct(solid)))::BIGINT AS n_dup_lines,
               coalesce(r.n, 0)::BIGINT AS n_repeat_words,
               array_to_string(good, chr(10)) AS clean_text, len(lines)::BIGINT AS n_lines,
               (len(lines) - len(good))::BIGINT AS n_lines_removed,
               ({solid_length("t")} - {solid_length("array_to_string(good, chr(10))")})::BIGINT AS chars_removed
        FROM cleaned c LEFT JOIN repeats r USING (doc_id)),
    judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               100 * chars_removed > 50 * word_chars AS lost_too_much
        FROM measured)"""


QUALITY = f"""WITH {quality_ctes("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT lost_too_much AS kept, n_lines, n_lines_removed, chars_removed
FROM judged"""


DEDUP = f"""WITH d AS (SELECT doc_id, {FOLD.format("text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""


def near_ctes(table: str) -> str:
    """CTEs up to ``parts``: ``doc_id, n_shingles, component_id`` of every row of ``table``."""
    return f"""
    folded AS (SELECT doc_id, {words(FOLD.format("text"))} AS ws FROM {table}),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM folded WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common_parts AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common_parts JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * k >= 75 * (p.n + q.n - k)),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
        SELECT doc_id AS node, doc_id AS seen FROM {table}
        UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
    parts AS (
        SELECT node AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id
        FROM reach LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node)"""


NEAR = f"WITH RECURSIVE {near_ctes('documents')} SELECT * FROM parts"


def mix_ctes(table: str) -> str:
    """CTEs up to ``mixed``: every row of ``table`` with ``size, source_size, target, repeats``."""
    return f"""
    sized AS (
        SELECT *, len({words("text")})::BIGINT AS size,
               ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 15))::BIGINT AS hash
        FROM {table}),
    ranked AS (
        SELECT source, sum(size)::DOUBLE AS source_size,
               (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
        FROM sized GROUP BY source),
    limits AS (SELECT *, 3 * source_size / weight AS cap_at FROM ranked),
    shares AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS share
        FROM limits
        WINDOW o AS (ORDER BY cap_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
        SELECT source, source_size,
               least(3 * source_size, weight * (SELECT arg_min(share, cap_at) FROM shares WHERE cap_at >= share)) AS target
        FROM shares),
    budgets AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
    by_hash AS (SELECT source, hash, sum(size) AS held FROM sized GROUP BY ALL),
    filled AS (SELECT *, sum(held) OVER (PARTITION BY source ORDER BY hash) AS cum FROM by_hash),
    more AS (
        SELECT f.source, f.hash,
               cum <= target - whole * source_size
               OR (cum - held <= target - whole * source_size AND 2 * (target - whole * source_size - (cum - held)) > held) AS again
        FROM filled f JOIN budgets b ON f.source IS NOT DISTINCT FROM b.source),
    mixed AS (
        SELECT s.*, b.source_size::BIGINT AS source_size, b.target,
               least(3, b.whole + CASE WHEN m.again AND b.source_size > 0 THEN 1 ELSE 0 END)::BIGINT AS repeats
        FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
        JOIN more m ON m.source IS NOT DISTINCT FROM s.source AND m.hash = s.hash)"""


MIX = f"""WITH {mix_ctes("documents")}
SELECT doc_id, size, source_size, round(target, 6) AS target, size * repeats AS taken FROM mixed"""

NEGATIVES = """
WITH moved AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM moved a JOIN moved r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 5"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
WITH doc_terms AS (
    SELECT doc_id, row_number() OVER () AS d, regexp_extract_all({FOLD.format("text")}, '{_TERM}') AS ts FROM documents),
held AS (SELECT count(*) FILTER (WHERE len(ts) > 0)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM doc_terms),
occur AS (
    SELECT doc_id, d, n, term, count(*)::BIGINT AS tf
    FROM (SELECT doc_id, d, len(ts)::BIGINT AS n, unnest(ts) AS term FROM doc_terms) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occur, held GROUP BY term, big_n),
asked AS (
    SELECT item_id, i, term, count(*)::BIGINT AS times
    FROM (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all({FOLD.format("text")}, '{_TERM}')) AS term FROM benchmark)
    GROUP BY ALL),
scored AS (
    SELECT item_id, i, doc_id, d,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN occur USING (term) JOIN weights USING (term), held GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 20"""

ORACLE = {
    "op2_quality_rules": QUALITY,
    "op3_ngram_join": NEAR,
    "op5_mixing": MIX,
    "op6_exact_dedup": DEDUP,
    "op11_hard_negatives": NEGATIVES,
    "op12_lexical_search": SEARCH,
}
