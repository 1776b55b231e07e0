"""SQL for DuckDB that gives the expected result of each registered query.

Written relationally and independently of the column functions: text comes from
joining tokens with the entity list, attributes from plain patterns (RE2 has no
look-ahead), phone rules from lookup tables, the walk from a recursive query.
"""

from __future__ import annotations

from html.entities import name2codepoint

from contactlake import lookups
from contactlake.functions.urls import PARAMETER_SCHEMES
from contactlake.plans import derived

SHOP = derived.ALL_PAGES.format(pages="pages", customer="customer")
RAW = derived.RAW_CONTACTS.format(orders="orders")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + ")"


# --- HTML --------------------------------------------------------------------
# "=" opens a quoted value or stands before an unquoted one; any other quote is a plain character.
INSIDE = r"""(?:[^=>]|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>=])*(?:=\s*)?"""
ENTITY = r"&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);?"
TOKEN = text(
    r"<!--.*?(?:-->|\z)"
    rf"|<script(?:[\s/]{INSIDE})?>.*?(?:</script\s*>|\z)"
    rf"|<style(?:[\s/]{INSIDE})?>.*?(?:</style\s*>|\z)"
    rf"|</?[a-z]{INSIDE}>|<[!?][^>]*>|</?[a-z!?][^>]*\z|{ENTITY}|[^<&]+|[<&]"
)
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {text(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {text(WS + '+')}, ' ', 'g'))"


TOKENS = f"""pages_in AS ({SHOP}),
tokens AS (SELECT page_id, url, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
           FROM (SELECT page_id, url, regexp_extract_all(html, {TOKEN}, 0, 'is') AS t FROM pages_in))"""

ENTITIES = "entities(name, ch) AS " + values((text(n), f"chr({c})") for n, c in name2codepoint.items())

PIECES = f"""{ENTITIES},
pieces AS (
  SELECT page_id, pos,
         CASE WHEN token LIKE '&#x%' OR token LIKE '&#X%' THEN chr(CAST('0x' || rtrim(token[4:], ';') AS INT))
              WHEN token LIKE '&#_%' THEN chr(CAST(rtrim(token[3:], ';') AS INT))
              WHEN token LIKE '&%' THEN coalesce(ch, token)
              WHEN regexp_matches(token, '^<(script|style)\\b', 'i')
                   THEN regexp_extract(token, {text(rf'^<(?:script|style)\b{INSIDE}>(.*?)(?:</(?:script|style)\s*>)?$')}, 1, 'is')
              WHEN regexp_matches(token, '^<[a-z/!?]', 'i') THEN ''
              ELSE token END AS piece
  FROM tokens LEFT JOIN entities ON token LIKE '&%' AND name = rtrim(token[2:], ';')),
page_text AS (
  SELECT p.page_id, p.url, coalesce(t.text, '') AS text
  FROM pages_in p LEFT JOIN
       (SELECT page_id, {collapse("string_agg(piece, '' ORDER BY pos)")} AS text FROM pieces GROUP BY page_id) t USING (page_id))"""


def attr(name: str) -> str:
    value = f"""regexp_extract(tag, {text(rf'''[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)''')}, 1, 'is')"""
    return f"""regexp_replace({value}, '^["''](.*)["'']$', '\\1', 's')"""


TAGS = f"""tags AS (
  SELECT page_id, url, pos, lower(regexp_extract(tag, '^<([A-Za-z0-9]+)', 1)) AS name,
         {attr('href')} AS href, {attr('rel')} AS rel, {attr('content')} AS content, {attr('name')} AS meta_name,
         {attr('property')} AS property, {attr('http-equiv')} AS http_equiv,
         {attr('data-email')} AS data_email, {attr('data-phone')} AS data_phone
  FROM (SELECT page_id, url, pos, regexp_extract(token, {text(f'^<[a-z]{INSIDE}>')}, 0, 'is') AS tag FROM tokens)
  WHERE tag <> '')"""


def found(kind: str, origin: str, source: str, value: str, condition: str) -> str:
    return (
        f"SELECT DISTINCT page_id, url, '{kind}' AS kind, '{origin}' AS origin, raw "
        f"FROM (SELECT page_id, url, {value} AS raw FROM {source}) WHERE {condition}"
    )


PATTERN_MATCHES = "list_concat(" + ", ".join(
    f"regexp_extract_all(text, {text(p)}, 0, 'i')" for p in lookups.PHONE_PATTERNS
) + ")"
EMAIL_MATCHES = f"regexp_extract_all(text, {text(lookups.EMAIL_PATTERN)}, 0, 'i')"
TEL = "CASE WHEN name = 'a' AND href LIKE 'tel:%' THEN " + strip("replace(href, 'tel:', '')") + " END"
TEL_CUT = TEL.replace(" END", "").replace("THEN ", "THEN regexp_extract(", 1) + ", '^[^?&]*') END"
MAILTO = (
    "CASE WHEN name = 'a' AND href LIKE 'mailto:%' THEN regexp_extract("
    + strip("replace(href, 'mailto:', '')")
    + ", '^[^?&]*') END"
)
META = "CASE WHEN name = 'meta' AND (meta_name = 'telephone' OR property = 'telephone') THEN content END"


def candidates(tel: str, extra: bool) -> str:
    parts = [
        found("email", "text", "page_text", f"unnest({EMAIL_MATCHES})", "raw <> ''"),
        found("email", "mailto", "tags", MAILTO, "raw LIKE '%@%'"),
        found("email", "data_email", "tags", "data_email", "raw LIKE '%@%'"),
        found("phone", "text", "page_text", f"unnest({PATTERN_MATCHES})", "raw <> ''"),
        found("phone", "tel", "tags", tel, "raw <> ''"),
    ]
    if extra:
        parts.append(found("phone", "data_phone", "tags", "data_phone", "raw <> ''"))
        parts.append(found("phone", "meta", "tags", META, "raw <> ''"))
    return "candidates AS (" + " UNION ALL ".join(parts) + ")"


LINKS = f"""links AS (
  SELECT DISTINCT page_id, url, link FROM (
    SELECT page_id, url, {strip('href')} AS link FROM tags
    WHERE name = 'a' AND NOT regexp_matches({strip('href')}, '^(#|javascript:|mailto:|tel:|data:)')
    UNION ALL
    SELECT page_id, url, regexp_extract(content, 'url=([^\\s]+)', 1, 'i') FROM tags
    WHERE name = 'meta' AND http_equiv = 'refresh'
    UNION ALL
    SELECT page_id, url, href FROM tags WHERE name = 'link' AND rel = 'canonical')
  WHERE link <> '')"""

STRICT = f"{TOKENS}, {PIECES}, {TAGS}, {candidates(TEL_CUT, True)}"
SIMPLE = f"{TOKENS}, {PIECES}, {TAGS}, {candidates(TEL, False)}"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


# --- URLs --------------------------------------------------------------------
SPLIT = text(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")


def controls_removed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\t\r\n]', '', 'g')"


def part(x: str, i: int) -> str:
    return f"regexp_extract({controls_removed(x)}, {SPLIT}, {i}, 's')"


def netloc(x: str) -> str:
    return part(x, 2)


def split_columns(x: str, prefix: str) -> str:
    path, listed = part(x, 3), f"lower({part(x, 1)}) IN {in_list(PARAMETER_SCHEMES)}"
    return (
        f"lower({part(x, 1)}) AS {prefix}scheme, {part(x, 2)} AS {prefix}netloc, "
        f"CASE WHEN {listed} THEN regexp_replace({path}, ';[^/]*$', '') ELSE {path} END AS {prefix}path, "
        f"CASE WHEN {listed} THEN regexp_extract({path}, ';([^/]*)$', 1) ELSE '' END AS {prefix}params, "
        f"{part(x, 4)} AS {prefix}query, {part(x, 5)} AS {prefix}fragment"
    )


def resolved(source: str, link: str, base: str) -> str:
    """CTE chain from ``source`` with columns ``link`` and ``base`` to the resolved parts."""
    return f"""
split_both AS (SELECT *, {split_columns(link, 'l_')}, {split_columns(base, 'b_')} FROM {source}),
cases AS (SELECT *,
   l_netloc <> '' OR (l_scheme <> '' AND l_scheme <> b_scheme) AS absolute,
   l_path = '' AND l_params = '' AS same_page,
   CASE WHEN l_path LIKE '/%' THEN l_path
        ELSE regexp_replace(CASE WHEN regexp_extract(b_path, '^.*/') = '' THEN '/' ELSE regexp_extract(b_path, '^.*/') END || l_path, '/+', '/', 'g') END AS joined
   FROM split_both),
folded AS (SELECT *,
   substr(list_reduce(string_split(joined, '/'), lambda acc, seg: CASE seg WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || seg END, '')
   || CASE WHEN regexp_matches(joined, '/\\.\\.?$') THEN '/' ELSE '' END, 2) AS walked
   FROM cases),
parts AS (SELECT *,
   CASE WHEN l_scheme <> '' THEN l_scheme ELSE b_scheme END AS scheme,
   CASE WHEN absolute THEN l_netloc ELSE b_netloc END AS netloc,
   CASE WHEN absolute THEN l_path WHEN same_page THEN b_path WHEN walked = '' THEN '/' ELSE walked END AS path0,
   CASE WHEN absolute OR NOT same_page THEN l_params ELSE b_params END AS params,
   CASE WHEN absolute OR NOT same_page OR l_query <> '' THEN l_query ELSE b_query END AS query
   FROM folded),
located AS (SELECT *, CASE WHEN path0 = '' OR path0 LIKE '/%' THEN path0 ELSE '/' || path0 END AS path FROM parts)"""


NORMALIZED = """CASE WHEN link <> '' AND NOT regexp_matches(link, '^(#|mailto:|tel:|javascript:|data:)')
       AND scheme <> '' AND netloc <> '' THEN rtrim(scheme || '://' || netloc || path, '/') END"""


def page_key(x: str) -> str:
    """A page URL without query, fragment, params and trailing slashes."""
    path = f"regexp_replace({part(x, 3)}, ';[^/]*$', '')"
    full = f"rtrim(lower({part(x, 1)}) || '://' || {netloc(x)} || {path}, '/')"
    return f"CASE WHEN {part(x, 1)} <> '' AND {netloc(x)} <> '' THEN {full} ELSE {x} END"


def same_domain(url: str, domain: str) -> str:
    return (
        f"(coalesce({strip(url)}, '') <> '' AND CASE WHEN {netloc(url)} <> '' "
        f"THEN coalesce({netloc(url)} = {domain} OR ends_with({netloc(url)}, '.' || {domain}), NULL) "
        rf"ELSE regexp_matches({url}, '^(/|\./|\.\./)') END)"
    )


def domain_of(x: str) -> str:
    return (
        f"CASE WHEN coalesce({strip(x)}, '') = '' THEN NULL WHEN {netloc(x)} <> '' THEN {netloc(x)} "
        f"WHEN contains({x}, '.') AND NOT contains(split_part({x}, ':', 1), '/') THEN {x} END"
    )


TLD_TABLE = values((text(t), text(c)) for t, c in lookups.TLD_COUNTRY.items())


def home(x: str) -> str:
    """Home code of a URL, as a scalar subquery over the lookup table."""
    return f"(SELECT c FROM {TLD_TABLE} AS tlds(t, c) WHERE t = lower(regexp_extract({netloc(x)}, '\\.([^.]*)$', 1)))"


# --- e-mail ------------------------------------------------------------------
def norm_email(x: str) -> str:
    return strip(f"lower(coalesce({x}, ''))")


def email_reason(e: str) -> str:
    local = f"split_part({e}, '@', 1)"
    domain = f"substr({e}, strpos({e}, '@') + 1)"
    return f"""CASE WHEN NOT contains({e}, '@') THEN 'no_at'
      WHEN length({local}) > 64 THEN 'local_too_long'
      WHEN length({domain}) > 255 THEN 'domain_too_long'
      WHEN NOT contains({domain}, '.') THEN 'domain_without_dot'
      WHEN {domain} LIKE '.%' OR {domain} LIKE '%.' THEN 'domain_edge_dot'
      WHEN {domain} IN {in_list(lookups.EXCLUDED_EMAIL_DOMAINS)} THEN 'excluded_domain'
      WHEN NOT regexp_full_match({local}, '[a-zA-Z0-9._%+-]+') THEN 'bad_local'
      WHEN NOT regexp_full_match({domain}, '[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 'bad_domain' END"""


# --- phone -------------------------------------------------------------------
def clean(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, '^\\s*\\+') AND regexp_matches({x}, '[0-9]') THEN '+' ELSE '' END"
        f" || regexp_replace({x}, '[^0-9]', '', 'g'))"
    )


CODES = "codes(code) AS " + values((text(c),) for c in lookups.country_codes())
LENGTHS = "lengths(code, n) AS " + values(
    (text(c), str(n)) for c, ns in lookups.COUNTRY_LENGTHS.items() for n in ns
)


def not_phone(d: str) -> str:
    same = "|".join(f"{i}{{6,}}" for i in range(10))
    runs = [digits[i : i + 6] for digits in ("1234567890", "0987654321") for i in range(5)]
    starts = " OR ".join(f"starts_with({d}, '{s}')" for s in runs)
    return f"(length({d}) < 7 OR length({d}) > 15 OR regexp_full_match({d}, '{same}') OR {starts} OR regexp_full_match({d}, '[01]+'))"


def suspicious(d: str, plus: str) -> str:
    return f"(NOT {plus} AND length({d}) >= 10 AND substr({d}, 1, 3) IN {in_list(lookups.SUSPICIOUS_STARTS)})"


def distinct_digits(d: str) -> str:
    return f"CASE WHEN {d} = '' THEN 0 ELSE len(list_distinct(string_split({d}, ''))) END"


def many_zeros(d: str) -> str:
    return f"(length({d}) > 0 AND (length({d}) - length(replace({d}, '0', ''))) / length({d}) > 0.6)"


def length_allowed(code: str, d: str) -> str:
    listed = " ".join(
        f"WHEN '{c}' THEN length({d}) IN ({', '.join(map(str, ns))})" for c, ns in lookups.COUNTRY_LENGTHS.items()
    )
    return f"CASE {code} {listed} ELSE length({d}) BETWEEN 8 AND 15 END"


def local_ok(d: str, h: str) -> str:
    n = f"length({d})"
    return f"""CASE {h}
      WHEN '7' THEN ({n} = 10 AND {d} LIKE '9%') OR ({n} = 11 AND ({d} LIKE '7%' OR {d} LIKE '8%'))
      WHEN '375' THEN ({n} = 12 AND {d} LIKE '375%') OR ({n} = 9 AND {d}[1:2] IN {in_list(lookups.BY_LOCAL_STARTS)})
      WHEN '380' THEN ({n} = 12 AND {d} LIKE '380%') OR ({n} = 9 AND {d}[1:2] IN {in_list(lookups.UA_MOBILE_STARTS)})
      WHEN '1' THEN {n} = 10 OR ({n} = 11 AND {d} LIKE '1%')
      ELSE false END"""


def likely_reason(d: str, plus: str, code: str, h: str) -> str:
    return f"""CASE WHEN {d} = '' THEN 'no_digits'
      WHEN length({d}) NOT BETWEEN 7 AND 15 THEN 'length'
      WHEN {not_phone(d)} THEN 'not_phone_pattern'
      WHEN {suspicious(d, plus)} THEN 'suspicious_start'
      WHEN {distinct_digits(d)} < 3 THEN 'few_unique_digits'
      WHEN {many_zeros(d)} THEN 'many_zeros'
      WHEN {plus} AND {code} IS NULL THEN 'country_code'
      WHEN {plus} AND {code} = '7' AND {d}[2:2] IN ('0', '1', '2') THEN 'ru_area'
      WHEN {plus} AND NOT {length_allowed(code, d)} THEN 'country_length'
      WHEN {plus} AND {h} = '7' AND {d} NOT LIKE '7%' THEN 'ru_domain'
      WHEN {plus} THEN NULL
      WHEN {h} IS NULL THEN 'no_home_country'
      WHEN NOT {length_allowed(h, d)} THEN 'local_length'
      WHEN NOT {local_ok(d, h)} THEN 'local_format' END"""


def normal_form(d: str, plus: str, code: str, h: str) -> str:
    n = f"length({d})"
    return f"""CASE WHEN {n} NOT BETWEEN 7 AND 15 THEN NULL
      WHEN {plus} THEN CASE WHEN {code} IS NOT NULL AND {length_allowed(code, d)} THEN '+' || {d} END
      WHEN {h} = '7' AND {n} = 10 AND {d} LIKE '9%' THEN '+7' || {d}
      WHEN {h} = '7' AND {n} = 11 AND {d}[1:1] IN ('7', '8') THEN '+7' || {d}[2:]
      WHEN {h} = '375' AND {n} = 12 AND {d} LIKE '375%' THEN '+' || {d}
      WHEN {h} = '375' AND {n} = 9 AND {d}[1:2] IN {in_list(lookups.BY_LOCAL_STARTS)} THEN '+375' || {d}
      WHEN {h} = '380' AND {n} = 12 AND {d} LIKE '380%' THEN '+' || {d}
      WHEN {h} = '380' AND {n} = 9 THEN '+380' || {d}
      WHEN {h} = '1' AND {n} = 10 THEN '+1' || {d}
      WHEN {h} = '1' AND {n} = 11 AND {d} LIKE '1%' THEN '+' || {d} END"""


def phone_chain(source: str, phone: str, home_code: str, keys: str) -> str:
    """CTEs from raw numbers to ``phones_checked(keys, normalized, reason, value, value_reason)``."""
    return f"""{CODES},
phones0 AS (SELECT {keys}, coalesce({clean(phone)}, '') AS cleaned, {home_code} AS home FROM {source}),
phones1 AS (SELECT *, ltrim(cleaned, '+') AS digits, cleaned LIKE '+%' AS has_plus FROM phones0),
phones2 AS (SELECT p.*, codes.code FROM phones1 p LEFT JOIN codes ON starts_with(p.digits, codes.code)),
phones3 AS (SELECT *, {normal_form('digits', 'has_plus', 'code', 'home')} AS normalized,
                   {likely_reason('digits', 'has_plus', 'code', 'home')} AS reason FROM phones2),
phones4 AS (SELECT p.*, ltrim(normalized, '+') AS nd, n.code AS ncode
            FROM phones3 p LEFT JOIN codes n ON starts_with(ltrim(p.normalized, '+'), n.code)),
phones_checked AS (SELECT *, CASE WHEN value_reason IS NULL THEN normalized END AS value FROM (
   SELECT *, CASE WHEN normalized IS NULL THEN 'not_normalized'
                  ELSE {likely_reason('nd', 'true', 'ncode', 'home')} END AS value_reason FROM phones4))"""


RAW_CTE = f"raw AS ({RAW})"
RAW_PHONES = (
    f"{RAW_CTE}, {CODES}, raw0 AS (SELECT k, url, {home('url')} AS home, coalesce({clean('phone')}, '') AS cleaned FROM raw), "
    "raw1 AS (SELECT *, ltrim(cleaned, '+') AS digits, cleaned LIKE '+%' AS has_plus FROM raw0), "
    "raw_phones AS (SELECT raw1.*, code FROM raw1 LEFT JOIN codes ON starts_with(digits, code))"
)
CHECKED = f"{RAW_CTE}, " + phone_chain("raw", "phone", home("url"), "k, url")

# valid contacts of the pages: valid(page_id, url, kind, value)
PAGE_PHONES = phone_chain("(SELECT * FROM candidates WHERE kind = 'phone')", "raw", home("url"), "page_id, url, origin, raw")
VALID = f"""{STRICT}, {LINKS}, {PAGE_PHONES},
valid AS (
  SELECT DISTINCT page_id, url, 'phone' AS kind, value FROM phones_checked WHERE value IS NOT NULL
  UNION ALL
  SELECT DISTINCT page_id, url, 'email', {norm_email('raw')} FROM candidates
  WHERE kind = 'email' AND {email_reason(norm_email('raw'))} IS NULL)"""


def listed(kind: str, relation: str = "valid", key: str = "page_id") -> str:
    return (
        f"(SELECT {key}, string_agg(value, '|' ORDER BY value) AS {kind}s FROM "
        f"(SELECT DISTINCT {key}, kind, value FROM {relation}) WHERE kind = '{kind}' GROUP BY {key})"
    )


# --- the walk ----------------------------------------------------------------
SEED_LINES = f"""seed_lines AS (
  SELECT seq, {strip('value')} AS seed_url FROM (
    SELECT page_id AS seq,
           CASE WHEN page_id % 10 = 4 THEN '  ' || url || chr(9)
                WHEN page_id % 100 = 6 THEN '   '
                WHEN page_id % 100 = 8 THEN 'not-a-url' ELSE url END AS value FROM pages_in)
  WHERE (value LIKE '%/c/0' OR seq % 2 = 0) AND {strip('value')} <> '')"""

KEPT_ONLY = "\n              WHERE page_id IN (SELECT min(page_id) FROM keyed GROUP BY url)"
EDGES = f"""keyed AS (SELECT page_id, {page_key('url')} AS url FROM pages_in),
link_rows AS (SELECT k.url AS base, trim(l.link) AS link FROM links l JOIN keyed k USING (page_id){KEPT_ONLY}),
{resolved('link_rows', 'link', 'base')},
edges AS MATERIALIZED (SELECT DISTINCT base AS src_url, {NORMALIZED} AS dst_url FROM located WHERE {NORMALIZED} IS NOT NULL)"""


ALL_EDGES = EDGES.replace(KEPT_ONLY, "")


def walk(max_pages: int | None, name: str = "visited") -> str:
    """Breadth-first levels by recursion until nothing is new, then the first ``max_pages`` of each seed."""
    limit = "" if max_pages is None else f"WHERE rank <= {max_pages}"
    return f"""{SEED_LINES},
seed_states AS MATERIALIZED (SELECT DISTINCT seed_url, {page_key('seed_url')} AS url, {netloc('seed_url')} AS domain
                FROM seed_lines WHERE {part('seed_url', 1)} <> '' AND {netloc('seed_url')} <> ''),
edge_hosts AS MATERIALIZED (SELECT *, {netloc('dst_url')} AS host FROM edges),
steps(seed_url, url, domain, depth) USING KEY (seed_url, url) AS (
  SELECT seed_url, url, domain, CAST(0 AS BIGINT) FROM seed_states
  UNION
  SELECT s.seed_url, e.dst_url, s.domain, s.depth + 1
  FROM steps s JOIN edge_hosts e ON e.src_url = s.url
  WHERE (e.host = s.domain OR ends_with(e.host, '.' || s.domain))
    AND NOT EXISTS (SELECT 1 FROM recurring.steps r WHERE r.seed_url = s.seed_url AND r.url = e.dst_url)),
levels AS (SELECT seed_url, url, min(depth) AS depth FROM steps GROUP BY seed_url, url),
{name} AS MATERIALIZED (SELECT seed_url, url, depth FROM (
   SELECT *, row_number() OVER (PARTITION BY seed_url ORDER BY depth, url) AS rank FROM levels) {limit})"""


WALK = f"RECURSIVE {VALID}, {EDGES}, {walk(None)}"
BUDGET_WALK = f"RECURSIVE {VALID}, {EDGES}, {walk(50)}"
WHOLE_WALK = f"RECURSIVE {STRICT}, {LINKS}, {EDGES}, {walk(None)}"
SITE_VALID = """kept_pages AS (SELECT url, min(page_id) AS page_id FROM keyed GROUP BY url),
site_valid AS (SELECT v.seed_url, c.kind, c.value FROM visited v JOIN kept_pages k ON k.url = v.url
               JOIN valid c ON c.page_id = k.page_id)"""


def site_states(limit: int | None) -> str:
    """``states(seed_url, status, visited, results, limit_reached)`` of the distinct seeds."""
    return f"""states AS (
  SELECT seed_url, coalesce(n, 0) AS visited, coalesce(have, 0) AS results, {f'coalesce(n, 0) >= {limit}' if limit else 'false'} AS limit_reached,
         CASE WHEN {part('seed_url', 1)} = '' OR {netloc('seed_url')} = '' THEN 'not_a_url' WHEN coalesce(have, 0) = 0 THEN 'no_page'
              WHEN seed_url NOT IN (SELECT seed_url FROM site_valid) THEN 'no_contacts' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT seed_url FROM seed_lines)
  LEFT JOIN (SELECT seed_url, count(*) AS n, count(k.url) AS have FROM visited LEFT JOIN kept_pages k USING (url) GROUP BY seed_url) USING (seed_url))"""


PAGE_RESULTS = f"""{VALID},
results AS (
  SELECT page_id, CASE WHEN page_id % 21 = 1 THEN 'no-domain' ELSE url END AS url,
         CASE WHEN page_id % 25 <> 2 THEN page_id % 9 <> 0 END AS success,
         CASE WHEN page_id % 9 <> 0 THEN coalesce(e.list, []) END AS emails,
         CASE WHEN page_id % 9 <> 0 THEN coalesce(p.list, []) END AS phones
  FROM pages_in
  LEFT JOIN (SELECT page_id, list(value ORDER BY value) AS list FROM valid WHERE kind = 'email' GROUP BY page_id) e USING (page_id)
  LEFT JOIN (SELECT page_id, list(value ORDER BY value) AS list FROM valid WHERE kind = 'phone' GROUP BY page_id) p USING (page_id))"""


def sequences() -> str:
    runs = {"".join(str((s + d * i) % 10) for i in range(6)) for s in range(10) for d in (1, -1)}
    return " OR ".join(f"contains(digits, '{r}')" for r in sorted(runs))


def phone_rule(name: str, expression: str) -> str:
    return with_(RAW_PHONES, f"SELECT k, digits, {expression} AS {name} FROM raw_phones")


def page_rows(kind: str, origin: str) -> str:
    return with_(STRICT, f"SELECT page_id, raw FROM candidates WHERE kind = '{kind}' AND origin = '{origin}'")


SITE_ROWS = f"SELECT DISTINCT {netloc('url')} AS site, page_id, kind, value FROM valid"
DEDUPED = f"SELECT site, kind, value, count(*) AS pages FROM ({SITE_ROWS}) GROUP BY ALL"
SIMPLE_EMAIL = f"""(SELECT page_id, string_agg(v, '|' ORDER BY v) AS emails FROM (
   SELECT DISTINCT page_id, {norm_email('raw')} AS v FROM candidates WHERE kind = 'email' AND contains({norm_email('raw')}, '@')) GROUP BY page_id)"""
SIMPLE_PHONE = f"""(SELECT page_id, string_agg(v, '|' ORDER BY v) AS phones FROM (
   SELECT DISTINCT page_id, {clean('raw')} AS v FROM candidates WHERE kind = 'phone') WHERE length(ltrim(v, '+')) >= 7 GROUP BY page_id)"""
DOC_TEXT = f"docs AS (SELECT doc_id, {collapse('text')} AS text FROM documents)"
DOC_CHECKED = (
    f"{DOC_TEXT}, doc_raw AS (SELECT DISTINCT doc_id, raw FROM (SELECT doc_id, unnest({PATTERN_MATCHES}) AS raw FROM docs)), "
    + phone_chain("doc_raw", "raw", "CAST(NULL AS VARCHAR)", "doc_id")
)

RESULT_JSON = """CAST(to_json({'url': url, 'success': success, 'emails': emails, 'phones': phones,
  '_metadata': {'generated_at': '2024-01-01T00:00:00.000Z', 'parser_version': '2.0.0'}}) AS VARCHAR)"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "seed_urls": with_(f"pages_in AS ({SHOP}), {SEED_LINES}", "SELECT seq, seed_url FROM seed_lines"),
    "pages_source": "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages",
    "admitted_pages": with_(
        f"pages_in AS ({SHOP})",
        """SELECT page_id, url, content_type, content_length FROM (
             SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 'image/png'
                    WHEN page_id % 3 = 0 THEN 'Text/HTML; charset=utf-8' ELSE 'application/xhtml+xml' END AS content_type,
                    CAST(strlen(html) * CASE WHEN page_id % 13 = 0 THEN 5000 ELSE 1 END AS BIGINT) AS content_length
             FROM pages_in WHERE page_id % 11 <> 0)
           WHERE content_type <> 'image/png' AND content_length <= 10485760""",
    ),
    "dedup_pages": with_(
        f"pages_in AS ({SHOP})",
        """SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM (
             SELECT * FROM pages_in
             UNION ALL SELECT page_id + 1000000000000, url, html FROM pages_in WHERE page_id % 5 = 0
             UNION ALL SELECT page_id + 2000000000000, 'https://hot.example.org/', html FROM pages_in WHERE page_id % 3 = 0
             UNION ALL SELECT * FROM pages_in WHERE page_id % 4 = 0
             UNION ALL SELECT page_id, url || '#again', html FROM pages_in WHERE page_id % 10 = 1)
           QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1
           UNION ALL SELECT page_id + 3000000000000, NULL, CAST(strlen(html) AS BIGINT) FROM pages_in WHERE page_id % 7 = 0""",
    ),
    "result_json": with_(
        PAGE_RESULTS,
        f"SELECT page_id, {RESULT_JSON} AS json FROM results",
    ),
    "written_json": with_(PAGE_RESULTS, f"SELECT {RESULT_JSON} AS json FROM results"),
    "result_partitions": with_(
        f"pages_in AS ({SHOP})",
        f"""SELECT page_id, url, CASE WHEN NOT success THEN 'error' WHEN {netloc('url')} = '' THEN 'no_domain' ELSE 'ok' END AS status,
                   CASE WHEN success AND {netloc('url')} <> '' THEN replace({netloc('url')}, '.', '_') ELSE 'none' END AS domain_slug
            FROM (SELECT page_id, CASE WHEN page_id % 21 = 1 THEN 'no-domain' ELSE url END AS url,
                         page_id % 25 <> 2 AND page_id % 9 <> 0 AS success FROM pages_in)""",
    ),
    "written_partitions": with_(
        PAGE_RESULTS,
        f"""SELECT page_id, url, status, CASE WHEN status = 'ok' THEN replace({netloc('url')}, '.', '_') ELSE 'none' END AS domain_slug,
                   coalesce(len(emails), 0) AS n_emails, coalesce(len(phones), 0) AS n_phones, '2.0.0' AS parser_version
            FROM (SELECT *, CASE WHEN NOT coalesce(success, false) THEN 'error' WHEN {netloc('url')} = '' THEN 'no_domain' ELSE 'ok' END AS status FROM results)""",
    ),
    "page_status": with_(
        VALID,
        """SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 'rejected' WHEN page_id % 6 = 0 THEN 'empty'
                  WHEN page_id IN (SELECT page_id FROM valid) THEN 'ok' ELSE 'no_contacts' END AS status FROM pages_in""",
    ),
    "batch_summary": with_(
        f"pages_in AS ({SHOP})",
        """SELECT count(*) AS total, count(*) FILTER (page_id % 25 <> 2 AND page_id % 9 <> 0) AS successful,
                  count(*) FILTER (page_id % 25 = 2 OR page_id % 9 = 0) AS failed FROM pages_in""",
    ),
    "batch_summary_rows": with_(
        PAGE_RESULTS,
        """SELECT url, coalesce(success, false) AS success, coalesce(len(emails), 0) AS email_count,
                  coalesce(len(phones), 0) AS phone_count FROM results""",
    ),
    # URL functions
    "url_parts": with_(
        f"{RAW_CTE}, rows AS (SELECT k, coalesce(link, url, '') AS link FROM raw)",
        f"SELECT k, link, {split_columns('link', '')} FROM rows",
    ),
    "resolve_url": with_(
        f"{RAW_CTE}, rows AS (SELECT k, link AS original, trim(link) AS link, url FROM raw), "
        + resolved("rows", "link", "url"),
        """SELECT k, original AS link, url,
             CASE WHEN original IS NULL OR url IS NULL THEN NULL
                  WHEN link = '' THEN url
                  WHEN l_scheme <> '' AND l_netloc = '' AND l_scheme <> b_scheme THEN link
                  ELSE CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END
                       || CASE WHEN netloc <> '' THEN '//' || netloc ELSE '' END || path
                       || CASE WHEN params <> '' THEN ';' || params ELSE '' END
                       || CASE WHEN query <> '' THEN '?' || query ELSE '' END
                       || CASE WHEN l_fragment <> '' THEN '#' || l_fragment ELSE '' END END AS resolved
           FROM located""",
    ),
    "normalize_url": with_(
        f"{RAW_CTE}, rows AS (SELECT k, link AS original, url AS page, coalesce({strip('link')}, '') AS link, coalesce(url, '') AS url FROM raw), "
        + resolved("rows", "link", "url"),
        f"SELECT k, original AS link, page AS url, {NORMALIZED} AS normalized FROM located",
    ),
    "is_same_domain": with_(
        f"{RAW_CTE}, rows AS (SELECT k, link, regexp_replace({netloc('url')}, ':.*', '') AS domain FROM raw)",
        f"SELECT k, link, {same_domain('link', 'domain')} AS same_domain FROM rows",
    ),
    "validate_url": with_(
        RAW_CTE, f"SELECT k, link, coalesce({part('link', 1)} <> '' AND {netloc('link')} <> '', false) AS valid FROM raw"
    ),
    "get_domain": with_(
        RAW_CTE, f"SELECT k, {domain_of('link')} AS link_domain, {domain_of('url')} AS url_domain FROM raw"
    ),
    "home_country": with_(RAW_CTE, f"SELECT k, url, {home('url')} AS home_code FROM raw"),
    # HTML
    "parse_gate": with_(
        f"{VALID}",
        """SELECT page_id, CASE WHEN page_id % 6 = 0 OR page_id % 15 = 0 THEN 0 ELSE coalesce(v.n, 0) + coalesce(l.n, 0) END AS n_found
           FROM pages_in LEFT JOIN (SELECT page_id, count(*) AS n FROM valid GROUP BY page_id) v USING (page_id)
                LEFT JOIN (SELECT page_id, count(*) AS n FROM links GROUP BY page_id) l USING (page_id)""",
    ),
    "html_tokens": with_(TOKENS, "SELECT page_id, CAST(pos AS BIGINT) AS pos, token FROM tokens"),
    "html_text": with_(f"{TOKENS}, {PIECES}", "SELECT page_id, text FROM page_text"),
    "anchor_hrefs": with_(
        f"{TOKENS}, {TAGS}", f"SELECT DISTINCT page_id, {strip('href')} AS href FROM tags WHERE name = 'a' AND {strip('href')} <> ''"
    ),
    "mailto_candidates": page_rows("email", "mailto"),
    "data_email_candidates": page_rows("email", "data_email"),
    "tel_candidates": page_rows("phone", "tel"),
    "data_phone_candidates": page_rows("phone", "data_phone"),
    "meta_phone_candidates": page_rows("phone", "meta"),
    "page_links": with_(f"{TOKENS}, {TAGS}, {LINKS}", "SELECT page_id, link FROM links"),
    "clean_html": with_(
        f"pages_in AS ({SHOP})",
        "SELECT page_id, regexp_replace(html, "
        + text("|".join(rf"<{e}\b(?:{INSIDE}>.*?(?:</{e}\s*>|\z)|.*\z)" for e in ("script", "style", "noscript")))
        + ", '', 'gis') AS html FROM pages_in",
    ),
    "match_all": """SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, '[a-z]+ [0-9]{3,}', 0, 'i'),
                           regexp_extract_all(text, '[0-9]+ [a-z]+', 0, 'i'),
                           regexp_extract_all(text, '\\pL+ [0-9]{4}', 0, 'i'))) AS match FROM documents""",
    # e-mail
    "email_text_matches": with_(
        f"{STRICT}, {DOC_TEXT}",
        f"""SELECT DISTINCT doc_id AS page_id, 'document' AS source, raw FROM (SELECT doc_id, unnest({EMAIL_MATCHES}) AS raw FROM docs)
            UNION ALL SELECT page_id, 'page', raw FROM candidates WHERE kind = 'email' AND origin = 'text'""",
    ),
    "email_candidates": with_(STRICT, "SELECT page_id, origin, raw FROM candidates WHERE kind = 'email'"),
    "normalize_email": with_(RAW_CTE, f"SELECT k, {norm_email('email')} AS normalized FROM raw"),
    "is_valid_email": with_(
        f"{RAW_CTE}, rows AS (SELECT k, {norm_email('email')} AS e FROM raw)",
        f"SELECT k, {email_reason('e')} IS NULL AS valid, {email_reason('e')} AS reason FROM rows",
    ),
    "bad_domain_filter": with_(
        f"{RAW_CTE}, rows AS (SELECT k, {norm_email('email')} AS e FROM raw)",
        f"SELECT k, e AS normalized FROM rows WHERE contains(e, '@') AND substr(e, strpos(e, '@') + 1) NOT IN {in_list(lookups.EXCLUDED_EMAIL_DOMAINS)}",
    ),
    "valid_emails": with_(
        f"{RAW_CTE}, rows AS (SELECT {norm_email('email')} AS e FROM raw)",
        f"SELECT DISTINCT e AS email FROM rows WHERE {email_reason('e')} IS NULL",
    ),
    "emails_simple_mode": with_(SIMPLE, f"SELECT page_id, coalesce(emails, '') AS emails FROM pages_in LEFT JOIN {SIMPLE_EMAIL} USING (page_id)"),
    "site_email_filter": with_(
        RAW_CTE, f"SELECT k, {norm_email('email')} AS email FROM raw WHERE contains(email, '@') AND contains(split_part(email, '@', 2), '.')"
    ),
    "email_domain_class": with_(
        f"{RAW_CTE}, rows AS (SELECT {norm_email('email')} AS e FROM raw)",
        f"""SELECT CASE WHEN d IN {in_list(lookups.EXCLUDED_EMAIL_DOMAINS)} THEN 'excluded'
                        WHEN d IN {in_list(lookups.KNOWN_EMAIL_DOMAINS)} THEN 'known' ELSE 'other' END AS domain_class, count(*) AS n
            FROM (SELECT substr(e, strpos(e, '@') + 1) AS d FROM rows WHERE contains(e, '@')) GROUP BY 1""",
    ),
    # phone
    "phone_text_matches": with_(
        DOC_TEXT, f"SELECT DISTINCT doc_id, raw FROM (SELECT doc_id, unnest({PATTERN_MATCHES}) AS raw FROM docs)"
    ),
    "phone_candidates": with_(STRICT, "SELECT page_id, origin, raw FROM candidates WHERE kind = 'phone'"),
    "clean_phone": with_(RAW_CTE, f"SELECT k, coalesce({clean('phone')}, '') AS cleaned FROM raw"),
    "phone_length_gate": phone_rule("phone_length_gate", "length(digits) BETWEEN 7 AND 15"),
    "not_phone_patterns": phone_rule("not_phone_patterns", not_phone("digits")),
    "suspicious_start": phone_rule("suspicious_start", suspicious("digits", "has_plus")),
    "unique_digits": phone_rule("unique_digits", f"CAST({distinct_digits('digits')} AS BIGINT)"),
    "zero_ratio": phone_rule("zero_ratio", many_zeros("digits")),
    "country_code": phone_rule("country_code", "coalesce(code, '')"),
    "ru_area_rule": phone_rule("ru_area_rule", "coalesce(code = '7' AND digits[2:2] IN ('0', '1', '2'), false)"),
    "country_length": phone_rule("country_length", length_allowed("code", "digits")),
    "ru_domain_rule": phone_rule("ru_domain_rule", "coalesce(home = '7', false) AND has_plus AND digits NOT LIKE '7%'"),
    "local_format": phone_rule("local_format", local_ok("digits", "home")),
    "is_likely_phone": with_(CHECKED, "SELECT k, reason IS NULL AS likely FROM phones_checked"),
    "phone_reject_reason": with_(CHECKED, "SELECT k, reason FROM phones_checked"),
    "normalize_phone": with_(CHECKED, "SELECT k, normalized FROM phones_checked"),
    "valid_phones": with_(CHECKED, "SELECT DISTINCT url, value FROM phones_checked WHERE value IS NOT NULL"),
    "phones_simple_mode": with_(SIMPLE, f"SELECT page_id, coalesce(phones, '') AS phones FROM pages_in LEFT JOIN {SIMPLE_PHONE} USING (page_id)"),
    "is_sequential": phone_rule("is_sequential", f"({sequences()})"),
    "is_too_perfect": phone_rule(
        "is_too_perfect",
        """(digits <> '' AND (digits = repeat(digits[1:1], length(digits))
            OR (length(digits) >= 8 AND digits[1:1] <> digits[2:2]
                AND starts_with(digits, repeat(digits[1:2], length(digits) // 2)))
            OR (length(digits) >= 6 AND reverse(digits) = digits)))""",
    ),
    "id_like_flag": phone_rule("id_like_flag", "(length(digits) BETWEEN 8 AND 12 OR (length(digits) >= 3 AND digits LIKE '00%'))"),
    "site_phone_filter": with_(
        RAW_CTE,
        f"SELECT k, {strip('phone')} AS phone FROM raw WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 6 AND 15",
    ),
    # aggregation, joins, order
    "page_contacts": with_(
        VALID,
        f"""SELECT page_id, url, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, coalesce(links, '') AS links
            FROM pages_in LEFT JOIN {listed('email')} USING (page_id) LEFT JOIN {listed('phone')} USING (page_id)
            LEFT JOIN (SELECT page_id, string_agg(link, '|' ORDER BY link) AS links FROM links GROUP BY page_id) USING (page_id)""",
    ),
    "document_contacts": with_(
        DOC_CHECKED,
        f"""SELECT doc_id, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones FROM docs
            LEFT JOIN (SELECT doc_id, string_agg(DISTINCT value, '|' ORDER BY value) AS phones FROM phones_checked WHERE value IS NOT NULL GROUP BY doc_id) USING (doc_id)
            LEFT JOIN (SELECT doc_id, string_agg(e, '|' ORDER BY e) AS emails FROM
                (SELECT DISTINCT doc_id, {norm_email('raw')} AS e FROM (SELECT doc_id, unnest({EMAIL_MATCHES}) AS raw FROM docs))
                WHERE {email_reason('e')} IS NULL GROUP BY doc_id) USING (doc_id)""",
    ),
    "contact_counts": with_(
        VALID,
        """SELECT page_id, url, coalesce(n_emails, 0) AS n_emails, coalesce(n_phones, 0) AS n_phones, coalesce(n_links, 0) AS n_links
           FROM pages_in LEFT JOIN (SELECT page_id, count(*) FILTER (kind = 'email') AS n_emails,
                                           count(*) FILTER (kind = 'phone') AS n_phones FROM valid GROUP BY page_id) USING (page_id)
           LEFT JOIN (SELECT page_id, count(*) AS n_links FROM links GROUP BY page_id) USING (page_id)""",
    ),
    "site_contact_counts": with_(
        VALID,
        f"""SELECT site, count(*) FILTER (kind = 'email') AS n_emails, count(*) FILTER (kind = 'phone') AS n_phones
            FROM ({DEDUPED}) GROUP BY site""",
    ),
    "contact_dedup": with_(VALID, DEDUPED),
    "sorted_contacts": with_(VALID, DEDUPED + " ORDER BY site, kind, value"),
    "longest_prefix": with_(
        RAW_PHONES,
        """SELECT r.k, r.digits, max_by(c.code, length(c.code)) AS code FROM raw_phones r
           LEFT JOIN (SELECT DISTINCT left(digits, CAST(k % 5 + 1 AS INT)) AS code FROM raw_phones WHERE k % 7 = 0 AND digits <> '') c
           ON starts_with(r.digits, c.code) GROUP BY r.k, r.digits""",
    ),
    "written_summary": with_(
        PAGE_RESULTS,
        """SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (success IS NOT TRUE) AS failed,
                  CAST(coalesce(sum(len(emails)), 0) AS BIGINT) AS emails, CAST(coalesce(sum(len(phones)), 0) AS BIGINT) AS phones FROM results""",
    ),
    "decoded_pages": with_(
        f"""pages_in AS ({SHOP}),
texts AS (SELECT page_id, url, CASE page_id % 4
  WHEN 1 THEN '<META http-equiv=content-type content="text/html; charset=Windows-1251">' || 'Привет, Ряким ' || CAST(page_id AS VARCHAR) || regexp_replace(html, '[^\\x00-\\x7F]', '', 'g')
  WHEN 3 THEN 'Café Müller ' || CAST(page_id AS VARCHAR) || regexp_replace(html, '[^\\x00-\\x7F\\x{{A0}}-\\x{{FF}}]', '', 'g') ELSE html END AS text FROM pages_in)""",
        """SELECT page_id, url, ['utf-8', 'windows-1251', 'utf-16le', 'windows-1252'][page_id % 4 + 1] AS charset, length(text) AS n_chars, md5(text) AS html_md5 FROM texts""",
    ),
    "redirected_links": with_(
        f"{TOKENS}, {TAGS}, {LINKS}, link_rows AS (SELECT url AS base, trim(link) AS link FROM links), ".replace(
            SHOP,
            f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://moved.example.org/at/' || CAST(page_id AS VARCHAR) || '/x' ELSE url END AS url, html FROM ({SHOP})""",
        )
        + resolved("link_rows", "link", "base"),
        f"SELECT DISTINCT base AS src_url, {NORMALIZED} AS dst_url FROM located WHERE {NORMALIZED} IS NOT NULL",
    ),
    "written_runs": with_(
        PAGE_RESULTS,
        f"""SELECT page_id, url, CASE page_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS run, status,
                   CASE WHEN status = 'ok' THEN replace({netloc('url')}, '.', '_') ELSE 'none' END AS domain_slug
            FROM (SELECT *, CASE WHEN NOT coalesce(success, false) THEN 'error' WHEN {netloc('url')} = '' THEN 'no_domain' ELSE 'ok' END AS status FROM results)""",
    ),
    "validation_funnel": with_(
        f"{STRICT}, {PAGE_PHONES}",
        f"""SELECT kind, outcome, count(*) AS n FROM (
              SELECT 'phone' AS kind, coalesce(value_reason, 'valid') AS outcome FROM phones_checked
              UNION ALL
              SELECT 'email', coalesce({email_reason(norm_email('raw'))}, 'valid') FROM candidates WHERE kind = 'email')
            GROUP BY ROLLUP (kind, outcome)""",
    ),
    "written_funnel": with_(
        f"{STRICT}, {PAGE_PHONES}",
        f"""SELECT kind, outcome, count(*) AS n FROM (
              SELECT 'phone' AS kind, coalesce(value_reason, 'valid') AS outcome FROM phones_checked
              UNION ALL
              SELECT 'email', coalesce({email_reason(norm_email('raw'))}, 'valid') FROM candidates WHERE kind = 'email')
            GROUP BY kind, outcome""",
    ),
    "lookup_joins": with_(
        RAW_PHONES,
        "SELECT k, home AS home_code, code, coalesce(CASE code "
        + " ".join(f"WHEN '{c}' THEN '{'|'.join(map(str, ns))}'" for c, ns in lookups.COUNTRY_LENGTHS.items())
        + " END, NULL) AS lengths FROM raw_phones",
    ),
    "set_operations": with_(
        STRICT,
        """SELECT DISTINCT page_id, kind, raw FROM candidates WHERE origin = 'text'
           EXCEPT SELECT page_id, kind, raw FROM candidates WHERE origin <> 'text'""",
    ),
    # link graph
    "link_edges": with_(
        f"{TOKENS}, {TAGS}, {LINKS}, keyed AS (SELECT page_id, {page_key('url')} AS url FROM pages_in), "
        "link_rows AS (SELECT k.url AS base, trim(l.link) AS link FROM links l JOIN keyed k USING (page_id)), "
        + resolved("link_rows", "link", "base")
        + f", {SEED_LINES}, homes AS (SELECT DISTINCT seed_url, {domain_of('seed_url')} AS domain FROM seed_lines)",
        f"""SELECT DISTINCT seed_url, base AS src_url, {NORMALIZED} AS dst_url FROM located
            JOIN homes ON (b_netloc = domain OR ends_with(b_netloc, '.' || domain)) AND (netloc = domain OR ends_with(netloc, '.' || domain))
            WHERE {NORMALIZED} IS NOT NULL""",
    ),
    "same_domain_links": with_(
        f"{TOKENS}, {TAGS}, {LINKS}, link_rows AS (SELECT url AS base, trim(link) AS link FROM links), " + resolved("link_rows", "link", "base"),
        f"""SELECT DISTINCT base AS src_url, {NORMALIZED} AS dst_url FROM located
            WHERE {NORMALIZED} IS NOT NULL AND (netloc = b_netloc OR ends_with(netloc, '.' || b_netloc))""",
    ),
    "unvisited_links": with_(
        f"{TOKENS}, {TAGS}, {LINKS}, {ALL_EDGES}", "SELECT dst_url AS url FROM edges EXCEPT SELECT url FROM keyed"
    ),
    "frontier_fetch": with_(
        f"{TOKENS}, {TAGS}, {LINKS}, {ALL_EDGES}",
        "SELECT url, url IN (SELECT url FROM keyed) AS fetched FROM (SELECT DISTINCT dst_url AS url FROM edges)",
    ),
    "reachable_pages": with_(WHOLE_WALK, "SELECT seed_url, url, depth FROM visited"),
    "page_budget": with_(f"RECURSIVE {STRICT}, {LINKS}, {EDGES}, {walk(50)}", "SELECT seed_url, url, depth FROM visited"),
    "crawl_progress": with_(
        f"RECURSIVE {STRICT}, {LINKS}, {EDGES}, {walk(50)}",
        """SELECT seed_url, count(*) AS visited, count(*) FILTER (url IN (SELECT url FROM keyed)) AS results,
                  count(*) >= 50 AS limit_reached, max(depth) AS depth FROM visited GROUP BY seed_url""",
    ),
    "site_contacts": with_(
        f"{BUDGET_WALK}, {SITE_VALID}, {site_states(50)}",
        f"""SELECT seed_url, status, limit_reached, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones
            FROM states
            LEFT JOIN {listed('email', 'site_valid', 'seed_url')} USING (seed_url)
            LEFT JOIN {listed('phone', 'site_valid', 'seed_url')} USING (seed_url)""",
    ),
    "batch_contacts": with_(
        f"{BUDGET_WALK}, {SITE_VALID}, {site_states(50)}",
        f"""SELECT seq, seed_url AS url, results > 0 AS success, status,
                   coalesce(emails, '') AS emails, coalesce(phones, '') AS phones FROM seed_lines JOIN states USING (seed_url)
            LEFT JOIN {listed('email', 'site_valid', 'seed_url')} USING (seed_url)
            LEFT JOIN {listed('phone', 'site_valid', 'seed_url')} USING (seed_url)
            ORDER BY seq""",
    ),
    "site_contact_parts": with_(
        f"{WALK}, {SITE_VALID}",
        """SELECT seed_url, kind, part, count(*) AS n_values, string_agg(value, '|' ORDER BY value) AS values
           FROM (SELECT *, (row_number() OVER (PARTITION BY seed_url, kind ORDER BY value) - 1) // 50 AS part
                 FROM (SELECT DISTINCT seed_url, kind, value FROM site_valid)) GROUP BY seed_url, kind, part""",
    ),
    "batch_status": with_(
        f"{WALK}, {SITE_VALID}, {site_states(None)}",
        "SELECT seq, seed_url AS url, results > 0 AS success, status, visited, results, limit_reached FROM seed_lines JOIN states USING (seed_url)",
    ),
    "walk_from_stream": with_(f"RECURSIVE {STRICT}, {LINKS}, {ALL_EDGES}, {walk(None)}", "SELECT seed_url, url, depth FROM visited"),
    # stream
    "contacts_from_stream": with_(
        VALID.replace(SHOP, "SELECT page_id, url, html FROM pages"),
        f"SELECT page_id, url, {netloc('url')} AS site, kind, value FROM valid",
    ),
    "new_contacts_from_stream": with_(VALID, f"SELECT DISTINCT {netloc('url')} AS site, kind, value FROM valid"),
}
