"""The queries in DuckDB SQL."""

from __future__ import annotations

from corpusflow.llm import filter_audit, licences, quality, url_rules

#: CRC-32 of a text's UTF-8 bytes, a table built from the polynomial and folded over the bytes.
CRC32 = """crc_steps AS (
    SELECT b, 0 AS k, b AS c FROM range(256) AS r(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8),
bytes_of AS (
    SELECT row_no, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes
    FROM (SELECT row_no, text, hex(encode(text)) AS h FROM plain)
), crc AS (
    SELECT row_no, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc32
    FROM bytes_of, crc_table
)"""

SHARDS = f"""WITH RECURSIVE plain AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), {CRC32}, sized AS (
    SELECT doc_id, (strlen(text) + 8)::BIGINT AS size, crc32::BIGINT AS text_crc32 FROM plain JOIN crc USING (row_no)
), placed AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS place, sum(size) OVER () AS total
    FROM sized
), cut AS (SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut"""


def _quality() -> str:
    sizes = sorted(quality.NGRAM_LIMITS)
    word = r"[^\x20\x09-\x0D]+"
    grams = ", ".join(
        f"""CASE WHEN count(*) OVER (PARTITION BY row_no, array_to_string(list_slice(ws, i, i + {n - 1}), ' '), i + {n - 1} <= len(ws)) > 1
        AND i + {n - 1} <= len(ws) THEN 1 ELSE 0 END AS rep_{n}"""
        for n in sizes
    )
    covers = ", ".join(f"max(rep_{n}) OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS cov_{n}" for n in sizes)
    sums = ", ".join(f"sum(CASE WHEN cov_{n} = 1 THEN length(w) ELSE 0 END)::BIGINT AS dup_{n}_chars" for n in sizes)
    shown = ", ".join(f"coalesce(dup_{n}_chars, 0)::BIGINT AS dup_{n}_chars" for n in sizes)
    limits = " OR ".join(f"100 * dup_{n}_chars > {m} * word_chars" for n, m in quality.NGRAM_LIMITS.items())
    return f"""WITH plain AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT row_no, regexp_extract_all(text, '{word}') AS ws FROM plain
), words AS (
    SELECT row_no, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split
), repeated AS (SELECT row_no, i, w, {grams} FROM words),
covered AS (SELECT row_no, w, {covers} FROM repeated),
per_text AS (
    SELECT row_no, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(cov_5)::BIGINT AS n_repeat_words, {sums}
    FROM covered GROUP BY row_no
), lines AS (
    SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM plain
), full_lines AS (SELECT row_no, line, count(*) AS copies FROM lines WHERE regexp_matches(line, '{word}') GROUP BY row_no, line),
per_line AS (
    SELECT row_no, sum(copies - 1)::BIGINT AS n_dup_lines, sum(length(line) * copies)::BIGINT AS line_chars,
        sum(length(line) * (copies - 1))::BIGINT AS dup_line_chars
    FROM full_lines GROUP BY row_no
), counts AS (
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars,
        coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {shown}
    FROM plain LEFT JOIN per_text USING (row_no) LEFT JOIN per_line USING (row_no)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_WORDS} * n_words AS base_failed,
    NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_WORDS} * n_words
        OR 100 * dup_line_chars > {quality.LINE_LIMIT} * line_chars OR {limits}) AS kept
FROM counts"""


QUALITY = _quality()

SHINGLE_JOIN = r"""WITH RECURSIVE plain AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), shingles AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END)) AS shingle FROM plain
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(node, seen) USING KEY (node) AS (
    SELECT doc_id, doc_id FROM sizes
    UNION SELECT l.a, min(r.seen) FROM links l JOIN reach r ON l.b = r.node JOIN recurring.reach own ON own.node = l.a
    WHERE r.seen < own.seen GROUP BY l.a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(seen, doc_id) AS component_id
FROM plain LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON node = doc_id"""

PASSAGES = """WITH plain AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), places AS (
    SELECT row_no, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM plain WHERE length(h) >= 100
), windows AS (SELECT row_no, doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM places),
early AS (
    SELECT row_no, p FROM windows JOIN (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(*) > 1) USING (w) WHERE first < doc_id
), islands AS (
    SELECT row_no, p, sum(CASE WHEN p > last + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY row_no ORDER BY p) AS island
    FROM (SELECT row_no, p, coalesce(lag(p) OVER (PARTITION BY row_no ORDER BY p), p) AS last FROM early)
), spans AS (SELECT row_no, island, min(p) AS a, max(p) + 50 AS b FROM islands GROUP BY row_no, island),
gaps AS (
    SELECT row_no, a, b, lead(a) OVER (PARTITION BY row_no ORDER BY a) AS next_a, row_number() OVER (PARTITION BY row_no ORDER BY a) AS nth FROM spans
), kept AS (
    SELECT row_no, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
        string_agg(CASE WHEN nth = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(next_a, length(h) // 2) - b)), '' ORDER BY a) AS rest
    FROM gaps JOIN plain USING (row_no) GROUP BY row_no
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM plain LEFT JOIN kept USING (row_no)"""


def _licences() -> str:
    rows = []
    for name, text in licences.TEMPLATES:
        grams = licences.template_bigrams(text)
        low, high = licences.size_bounds(len(grams))
        listed = ", ".join(f"'{g}'" for g in grams)
        rows.append(f"('{name}', [{listed}], {low}, {high})")
    least = min(licences.size_bounds(len(licences.template_bigrams(t)))[0] for _, t in licences.TEMPLATES)
    return f"""WITH templates(license, own, low, high) AS (VALUES {", ".join(rows)}),
plain AS (
    SELECT row_number() OVER () AS row_no, doc_id, translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}') AS folded FROM documents
), lined AS (SELECT row_no, doc_id, folded, string_split(folded, chr(10)) AS lines FROM plain),
blocks AS (
    SELECT row_no, unnest(lines) AS body, unnest(range(1, len(lines) + 1)) AS block FROM lined
    UNION ALL SELECT row_no, folded, 0 FROM lined WHERE len(lines) > 1
), worded AS (SELECT row_no, block, regexp_extract_all(body, '{licences.WORD}') AS ws FROM blocks),
paired AS (
    SELECT row_no, block, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams
    FROM worded WHERE len(ws) > {least}
), scored AS (
    SELECT row_no, block, license, len(list_intersect(grams, own)) * 2.0::DOUBLE / (len(grams) + len(own)) AS dice
    FROM paired JOIN templates ON len(grams) BETWEEN low AND high
), best AS (
    SELECT row_no, block, license, dice FROM scored WHERE dice * 100 >= {licences.THRESHOLD_PERCENT}
    QUALIFY row_number() OVER (PARTITION BY row_no, block ORDER BY dice DESC, license) = 1
), per_row AS (
    SELECT row_no, count(*) AS n_found, max_by(license, (dice, -block)) AS license, max(dice) AS dice, max_by(block, (dice, -block)) AS block,
        string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
    FROM best GROUP BY row_no
)
SELECT doc_id, len(lines)::BIGINT AS n_blocks, coalesce(n_found, 0)::BIGINT AS n_found, license, round(dice, 9) AS dice, block::BIGINT AS block,
    coalesce(licenses, '') AS licenses
FROM lined LEFT JOIN per_row USING (row_no)"""


LICENCES = _licences()

FILTER_AUDIT = rf"""WITH RECURSIVE plain AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM plain),
first_of AS (SELECT text, min(doc_id) AS first FROM plain GROUP BY text),
marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT row_no, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < {filter_audit.MIN_WORDS} THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > {filter_audit.MAX_UPPER_PERCENT} * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN first < worded.doc_id THEN 'E' ELSE '' END AS fails
    FROM worded JOIN first_of USING (text) LEFT JOIN marks ON marks.doc_id = worded.doc_id
), orders AS (
    SELECT '' AS filter_order UNION ALL
    SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
    FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(filter_order) = 5
), met AS (
    SELECT part, filter_order, step, f, good, toxic, fails = f AS alone, contains(fails, f) AS hit,
        length(translate(before, fails, '')) < length(before) AS gone
    FROM judged, steps
), counted AS (
    SELECT part, filter_order, step, f, count(*) FILTER (WHERE NOT gone AND NOT hit) AS kept, count(*) FILTER (WHERE hit AND NOT gone) AS removed,
        count(*) FILTER (WHERE hit AND gone) AS redundant, count(*) FILTER (WHERE alone) AS unique_fails,
        count(*) FILTER (WHERE hit AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE hit AND NOT gone AND toxic) AS toxic_lost
    FROM met GROUP BY ALL
)
SELECT * EXCLUDE f, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted"""

URL_FILTER = rf"""WITH split AS (
    SELECT row_number() OVER () AS row_no, page_id, url, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS raw_host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), placed AS (
    SELECT row_no, page_id, url, u, translate(raw_host, '{url_rules.string.ascii_uppercase}', '{url_rules.string.ascii_lowercase}') AS host, path FROM split
), rules(rule_host, rule_path, rule, said) AS (
    VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
        ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
), tokens AS (
    SELECT DISTINCT url, unnest(list_distinct(list_transform(
        list_filter([translate(regexp_extract(u, '(?s)^(.*?)://', 1), '{url_rules.string.ascii_uppercase}', '{url_rules.string.ascii_lowercase}')], lambda x: x <> ''),
        lambda x: 's:' || regexp_replace(x, '[0-9]+', '#', 'g'))
        || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '#', 'g'))
        || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))
        || list_transform(list_filter(string_split(regexp_extract(u, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_replace(x, '[0-9]+', '#', 'g'))
        || list_transform(list_filter(string_split(regexp_extract(u, '(?s)://[^#]*#(.*)$', 1), chr(10)), lambda x: x <> ''), lambda x: 'f:' || regexp_replace(x, '[0-9]+', '#', 'g'))
    )) AS token FROM placed WHERE url IS NOT NULL
), marks AS (
    SELECT doc_id, coalesce(bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)), false) AS blocked FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), labelled AS (
    SELECT row_number() OVER () AS no, url, blocked FROM placed JOIN marks ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) WHERE url IS NOT NULL
), bound AS (
    SELECT greatest({url_rules.MIN_URLS}, ceil(count(*) * {url_rules.MIN_SHARE}::DECIMAL(9, 6))::BIGINT) AS least FROM labelled
), frequent AS (
    SELECT token, count(*) AS urls FROM labelled JOIN tokens USING (url) GROUP BY token HAVING count(*) >= (SELECT least FROM bound)
), held AS (
    SELECT no, blocked, list(token ORDER BY urls, token)[1:{url_rules.MAX_TOKENS}] AS items FROM labelled JOIN tokens USING (url) JOIN frequent USING (token) GROUP BY ALL
), combined AS (
    SELECT no, blocked, list_sort(list_filter(items, lambda x, i: (picked >> (i - 1)) & 1 = 1)) AS combination
    FROM (SELECT no, blocked, items, unnest(range(1, 1::BIGINT << len(items))) AS picked FROM held)
), mined AS (
    SELECT combination, count(*) AS urls, count(*) FILTER (WHERE blocked) AS blocked_urls FROM combined GROUP BY combination
    HAVING count(*) FILTER (WHERE blocked) >= (SELECT least FROM bound) AND 100 * count(*) FILTER (WHERE blocked) >= {url_rules.MIN_CONFIDENCE_PERCENT} * count(*)
), best AS (
    SELECT url, max((blocked_urls / urls, urls, combination)) AS b FROM (SELECT url, list(token) AS own FROM tokens GROUP BY url) JOIN mined ON list_has_all(own, combination) GROUP BY url
), longest AS (
    SELECT page_id, url, host, path, rule, said FROM placed LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rule) DESC NULLS LAST) = 1
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN b IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
    array_to_string(b[3], ' ') AS learned, round(b[1], 9) AS confidence
FROM longest LEFT JOIN best USING (url)"""

PREFIX_TRIE = rf"""WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ordered AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS pos FROM raw
), plain AS (SELECT DISTINCT conv_id AS row_no, conv_id::VARCHAR AS text FROM raw), {CRC32},
heads AS (SELECT row_no AS conv_id, crc32 % 4 AS h, row_no - row_no % 20 AS base FROM crc),
joined AS (
    SELECT heads.conv_id, 0 AS own, pos, role, text FROM heads JOIN ordered ON ordered.conv_id = base AND pos < h
    UNION ALL SELECT heads.conv_id, 1, pos, role, text FROM heads JOIN ordered ON ordered.conv_id = heads.conv_id AND pos >= h
), rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM joined),
prefixes AS (
    SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        sha256(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth))::VARCHAR) AS name FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM heads
), ended AS (
    SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends
    FROM (SELECT conv_id, max_by(name, depth) AS name FROM prefixes GROUP BY conv_id) GROUP BY name
), nodes AS (SELECT name, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs FROM prefixes GROUP BY name),
paths AS (
    SELECT nodes.name, nodes.depth, nodes.n_convs, nodes.words, p.name AS above, p.depth AS above_depth FROM nodes JOIN prefixes p ON p.conv_id = nodes.conv_id AND p.depth <= nodes.depth
), parents AS (SELECT name, above FROM paths WHERE above_depth = depth - 1),
children AS (SELECT above AS name, count(*) AS n_children FROM parents GROUP BY above),
totals AS (
    SELECT above AS name, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
    FROM paths LEFT JOIN children USING (name) GROUP BY above
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n JOIN totals USING (name) LEFT JOIN children USING (name) LEFT JOIN ended USING (name) LEFT JOIN parents USING (name) LEFT JOIN nodes u ON u.name = parents.above"""
