"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .decontaminate import LOWER, UPPER
from .line_dedup import LineRules
from .mixture import Mixture
from .url_filter import RULES, Tree

WORDS = r"'[^\x20\x09-\x0D]+'"


def decontamination() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
    dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    h AS (SELECT doc_id, s, n, item FROM dw JOIN bw USING (n, g)),
    p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""


def quality() -> str:
    return rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, {WORDS}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    t AS (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1) GROUP BY doc_id),
    f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(text) - length(translate(text, '!', '')) AS bangs,
        length(text) - length(translate(text, '{UPPER}', '')) AS n_upper, length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_letters FROM d LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_symbols > 0.25 * n_words OR n_upper > 0.6 * greatest(n_letters, 1) OR bangs > 0.3 * n_words
    OR (n_lines > 3 AND n_dup_lines > 0.5 * n_lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept FROM b"""


def near_duplicates() -> str:
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.other = e.x)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def _spread(source: str, parent: str, order: str, cap: str, weight: str, budget: str, out: str) -> str:
    """Water-filling of ``budget`` over the rows of each parent, up to their caps."""
    upto = f"OVER (PARTITION BY {parent} ORDER BY {cap} / {weight}, {order} ROWS UNBOUNDED PRECEDING)"
    whole = f"OVER (PARTITION BY {parent})"
    return f"""SELECT *, CASE WHEN f THEN {cap} ELSE least({cap}, ({budget} - coalesce(sum(CASE WHEN f THEN {cap} END) {whole}, 0)) / sum(CASE WHEN NOT f THEN {weight} END) {whole} * {weight}) END AS {out}
    FROM (SELECT *, sum({cap}) {upto} + {cap} / {weight} * (sum({weight}) {whole} - sum({weight}) {upto}) <= {budget} AS f FROM ({source}))"""


def _weights(column: str, weights: dict[str, float], default: float) -> str:
    if not weights:
        return f"CAST({default} AS DOUBLE)"
    return "CAST(CASE " + column + " ".join(["", *[f"WHEN '{k}' THEN {v}" for k, v in weights.items()], f"ELSE {default} END AS DOUBLE)"])


def mixing(m: Mixture) -> str:
    domain = "CASE WHEN regexp_full_match(source, 'src0{1,9}') THEN 'bulk' WHEN regexp_full_match(source, 'src[0-9]{0,8}[13579]') THEN 'web' WHEN regexp_full_match(source, 'src[0-9]{1,9}') THEN 'books' ELSE 'other' END"
    weight = lambda column, weights: _weights(column, weights, m.default_weight)
    one = f"SELECT domain, sum(cap2) AS cap1, {weight('domain', m.domains)} AS w1, (SELECT CAST(floor(sum(supply) * {m.share}) AS DOUBLE) FROM leaves) AS b0 FROM two GROUP BY domain"
    return f"""WITH r AS (SELECT *, {domain} AS domain FROM (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS n_tokens FROM documents)),
    leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM r GROUP BY ALL),
    three AS (SELECT *, CAST(supply * {m.max_epochs} AS DOUBLE) AS cap, {weight('source', m.sources)} AS w3 FROM leaves WHERE supply > 0),
    two AS (SELECT domain, lang, sum(cap) AS cap2, {weight('lang', m.languages)} AS w2 FROM three GROUP BY ALL),
    f1 AS (SELECT domain, b1 FROM ({_spread(one, 'b0', 'domain', 'cap1', 'w1', 'b0', 'b1')})),
    f2 AS (SELECT domain, lang, b2 FROM ({_spread('SELECT * FROM two JOIN f1 USING (domain)', 'domain', 'domain, lang', 'cap2', 'w2', 'b1', 'b2')})),
    f3 AS (SELECT domain, lang, source, CAST(supply AS BIGINT) AS supply, CAST(floor(b3 + 1e-6) AS BIGINT) AS budget FROM ({_spread('SELECT * FROM three JOIN f2 USING (domain, lang)', 'domain, lang', 'domain, lang, source', 'cap', 'w3', 'b2', 'b3')})),
    o AS (SELECT r.*, budget // supply AS whole, budget % supply AS rest, md5('{m.seed}:' || (budget // supply) || ':' || doc_id) AS o FROM r JOIN f3 USING (domain, lang, source)),
    u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o) AS upto FROM o)
    SELECT doc_id, domain, lang, source, n_tokens, epoch FROM (SELECT *, unnest(range(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM u)"""


def lines(rules: LineRules) -> str:
    d, long = rules.depth, rules.long_words
    enough = lambda short: f"CASE WHEN n >= {long} THEN {rules.long_docs} ELSE {short} END"
    return f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM s),
    m AS (SELECT *, list_transform(regexp_extract_all(line, {WORDS}), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM l),
    t AS (SELECT doc_id, place, w, len(w) AS n, array_to_string(w, ' ') AS key FROM m WHERE len(w) > 0),
    a AS (SELECT doc_id, list(place ORDER BY place) AS ps, list(n ORDER BY place) AS ns, list(key ORDER BY place) AS ks FROM t GROUP BY doc_id),
    p AS (SELECT *, list_filter(range(2, {long + 1}), lambda j: k + j - 1 <= len(ns) AND list_sum(ns[k:k + j - 1]) >= {long})[1] AS j FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS k FROM a) WHERE ns[k] < {long}),
    u AS (SELECT doc_id, key, least(n, {long}) AS n, [place] AS places FROM t UNION ALL SELECT doc_id, chr(10) || array_to_string(ks[k:k + j - 1], ' '), {long}, ps[k:k + j - 1] FROM p WHERE j IS NOT NULL),
    c AS (SELECT key, any_value(n) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM u GROUP BY key),
    b AS (SELECT key, any_value(w) AS w, any_value(n) AS n, any_value(n) - {d} AS m, least(any_value(n) - {d}, {rules.blocks}) AS b FROM t WHERE n >= {rules.merged_words} GROUP BY key),
    f AS (SELECT *, unnest(range(CASE WHEN n < {long} THEN i ELSE i + 1 END, CASE WHEN n < {long} THEN i + 1 ELSE b END)) AS j FROM (SELECT *, unnest(range(b)) AS i FROM b)),
    g AS (SELECT key, least(n, {long}) AS n, n || ' ' || i || ' ' || j || ' ' || array_to_string(w[1:{d}], ' ') || chr(10) || array_to_string(list_transform(range(b), lambda x: CASE WHEN x = i OR x = j THEN '<?>' ELSE array_to_string(w[{d} + x * m // b + 1:{d} + (x + 1) * m // b], ' ') END), chr(10)) AS general FROM f),
    e AS (SELECT general, any_value(n) AS n, count(DISTINCT key) AS kinds, min(first) AS first FROM g JOIN c USING (key, n) GROUP BY general HAVING count(*) > 1),
    r AS (SELECT general, any_value(first) AS first FROM (SELECT e.*, u.doc_id FROM e JOIN g USING (general) JOIN u USING (key)) GROUP BY general HAVING count(DISTINCT doc_id) >= {enough(rules.merged_docs).replace('n >=', 'any_value(n) >=')}),
    x AS (SELECT key, first FROM c WHERE docs >= {enough(rules.short_docs)} UNION ALL SELECT key, first FROM g JOIN r USING (general)),
    gone AS (SELECT key, min(first) AS first FROM x GROUP BY key),
    k AS (SELECT doc_id, unnest(CASE WHEN doc_id = first THEN list_filter(places, lambda q: NOT list_contains(low, q)) ELSE places END) AS place FROM (SELECT u.*, first, min(places) OVER (PARTITION BY u.doc_id, key) AS low FROM u JOIN gone USING (key)))
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS text, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped FROM (SELECT l.*, q.place IS NOT NULL AS dropped FROM l LEFT JOIN (SELECT DISTINCT * FROM k) q USING (doc_id, place)) GROUP BY doc_id"""


def urls(tree: Tree) -> str:
    rule = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'".format(r.name) for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))) + " END"
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)
    levels, last = "", "n0"
    for k in range(1, tree.depth + 6):  # levels of up to 66 segments; the tables have no longer paths
        levels += f""",
    k{k} AS (SELECT node, segs[{k}] AS seg, sum(labelled) AS n, sum(good) AS g FROM {last} WHERE len(segs) >= {k} GROUP BY ALL),
    a{k} AS (SELECT *, sum(n) OVER w AS all_n, sum(g) OVER w AS all_g, count(*) OVER w AS kids FROM k{k} WINDOW w AS (PARTITION BY node)),
    d{k} AS (SELECT node, seg, CASE WHEN kids = 1 OR coalesce(abs(g / nullif(n, 0)::DOUBLE - (all_g - g) / nullif(all_n - n, 0)::DOUBLE) > {tree.z} * sqrt(all_g / nullif(all_n, 0)::DOUBLE * (1 - all_g / nullif(all_n, 0)::DOUBLE) * (1 / nullif(n, 0)::DOUBLE + 1 / nullif(all_n - n, 0)::DOUBLE)), false) THEN seg ELSE '*' END AS t FROM a{k}),
    n{k} AS (SELECT host, segs, labelled, good, CASE WHEN d.t IS NULL THEN x.node ELSE x.node || '/' || d.t END AS node FROM {last} x LEFT JOIN d{k} d ON x.node = d.node AND x.segs[{k}] = d.seg)"""
        last = f"n{k}"
    masked = r"regexp_replace(regexp_replace(path, '([/_.-])[0-9a-f]{12,}($|[/_.-])', '\1{h}\2', 'g'), '[0-9]+', '{n}', 'g')"
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1), '') AS BIGINT) AS shown FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
    v AS (SELECT *, string_split({masked}, '/')[2:] AS parts FROM u),
    r AS (SELECT *, list_concat(parts[1:{tree.depth}], list_transform(list_filter(range(1, 30), lambda k: {tree.depth} + 2 ** k - 2 < len(parts)), lambda k: array_to_string(parts[{tree.depth} + CAST(2 ** k AS BIGINT) - 1:{tree.depth} + CAST(2 ** (k + 1) AS BIGINT) - 2], '/'))) AS segs FROM v),
    y AS (SELECT page_id, max(quality) AS good FROM u JOIN labels ON labels.doc_id = u.shown WHERE quality IN (0, 1) GROUP BY page_id),
    n0 AS (SELECT host, segs, count(good) AS labelled, coalesce(sum(good), 0) AS good, host AS node FROM r LEFT JOIN y USING (page_id) GROUP BY host, segs){levels},
    s AS (SELECT coalesce(sum(good) / nullif(sum(labelled), 0)::DOUBLE, 1.0) AS share FROM {last}),
    q AS (SELECT node, (sum(good) + {tree.prior} * any_value(share)) / (sum(labelled) + {tree.prior}) AS purity FROM {last}, s GROUP BY node)
    SELECT page_id, r.host, path, {rule.replace('host', 'r.host')} AS rule, coalesce(CASE {rule.replace('host', 'r.host')} {verdicts} END, CASE WHEN purity < {tree.least_purity} THEN 'block' ELSE 'allow' END) AS verdict, z.node AS template, round(purity, 6) AS purity
    FROM r JOIN {last} z ON r.host = z.host AND r.segs = z.segs JOIN q ON q.node = z.node"""
