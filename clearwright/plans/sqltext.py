"""SQL twins of the decision side, built up as lists of common table expressions."""

from __future__ import annotations

from clearwright.functions import purl as P
from clearwright.functions import verdict as V
from clearwright.plans import views as W

_SHAPE = r"(?is)^pkg:([^/?#]*)/([^?#]*?)(?:@([^@?#]*))?(?:\?([^#]*))?(?:#(.*))?$"


def select(views: list[str], text: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(views)) + "\n" + text


def decoded(x: str) -> str:
    return f"CASE WHEN contains({x}, '%') THEN url_decode({x}) ELSE {x} END"


def parsed(source: str, column: str, out: str) -> str:
    """Parse PURL texts of `source.column` (kept as is) into flat columns of `out`."""
    return f"""{out}_shape AS (
  SELECT *, regexp_matches(trim({column}), '{_SHAPE}') AS shaped,
    lower(regexp_extract(trim({column}), '{_SHAPE}', 1)) AS g_type, regexp_extract(trim({column}), '{_SHAPE}', 2) AS g_path,
    regexp_extract(trim({column}), '{_SHAPE}', 3) AS g_version, regexp_extract(trim({column}), '{_SHAPE}', 4) AS g_query,
    regexp_extract(trim({column}), '{_SHAPE}', 5) AS g_subpath
  FROM {source}),
{out}_split AS (
  SELECT *, CASE g_type WHEN 'go' THEN 'golang' WHEN 'crate' THEN 'cargo' WHEN 'rubygems' THEN 'gem' ELSE g_type END AS t,
    regexp_extract(g_path, '^(.*)/[^/]*$', 1) AS g_space, regexp_extract(g_path, '([^/]*)$', 1) AS g_name,
    list_filter(string_split(g_query, '&'), lambda x: x <> '') AS g_parts
  FROM {out}_shape),
{out} AS (
  SELECT * EXCLUDE (shaped, g_type, g_path, g_version, g_query, g_subpath, t, g_space, g_name, g_parts),
    coalesce(shaped AND g_name <> '' AND len(list_filter(g_parts, lambda x: NOT contains(x, '='))) = 0, FALSE) AS ok,
    t AS type,
    CASE WHEN t IN ('pypi','nuget','cargo','gem') THEN '' WHEN t IN ('npm','golang') THEN lower({decoded('g_space')})
      ELSE {decoded('g_space')} END AS namespace,
    CASE WHEN t = 'pypi' THEN translate(lower({decoded('g_name')}), '_.', '--')
      WHEN t IN ('npm','golang','nuget','cargo','gem') THEN lower({decoded('g_name')}) ELSE {decoded('g_name')} END AS name,
    {decoded('g_version')} AS version,
    list_sort(list_transform(g_parts, lambda x: lower({decoded("string_split(x, '=')[1]")}) || '=' || {decoded("regexp_replace(x, '^[^=]*=', '')")})) AS quals,
    {decoded('g_subpath')} AS subpath
  FROM {out}_split)"""


def qualifier(key: str) -> str:
    return (f"nullif(list_transform(list_filter(quals, lambda x: starts_with(x, '{key}=')), "
            f"lambda x: substr(x, {len(key) + 2}))[1], '')")


def quality(a: str, b: str) -> str:
    """Graded equivalence of two parsed row aliases."""
    ck = "nullif(list_transform(list_filter({0}.quals, lambda x: starts_with(x, 'checksum=')), lambda x: substr(x, 10))[1], '')"
    return f"""CASE
    WHEN NOT coalesce({a}.ok AND {b}.ok, FALSE) OR coalesce({ck.format(a)} <> {ck.format(b)}, FALSE) OR {a}.name <> {b}.name THEN 0
    WHEN {a}.type <> {b}.type THEN CASE WHEN {a}.version <> '' AND {a}.version = {b}.version THEN 2 ELSE 1 END
    WHEN {a}.namespace = {b}.namespace AND {a}.version = {b}.version AND {a}.quals = {b}.quals AND {a}.subpath = {b}.subpath THEN 5
    WHEN {a}.namespace = {b}.namespace AND {a}.version <> '' AND {a}.version = {b}.version THEN 3
    WHEN {a}.version <> '' AND {a}.version = {b}.version THEN 2
    WHEN {a}.namespace = {b}.namespace AND ({a}.version = '' OR {b}.version = '') THEN 3
    ELSE 1 END"""


def best(source: str, out: str, rank: str, component: str) -> str:
    return f"""{out}_graded AS (
  SELECT f.component_purl, c.component AS cc, coalesce({quality('f', 'c')}, 0) AS q,
    row_number() OVER (PARTITION BY f.component_purl ORDER BY coalesce({quality('f', 'c')}, 0) DESC, c.source_file, c.purl_pos) AS rn
  FROM {source} f LEFT JOIN catalogue c ON f.name = c.name),
{out} AS (
  SELECT s.*, g.q AS {rank}, CASE WHEN g.q >= 2 THEN g.cc END AS {component}
  FROM {source} s JOIN {out}_graded g ON s.component_purl = g.component_purl AND g.rn = 1)"""


DIRECT = [
    W.FINDINGS, W.COMPONENT_PURLS,
    parsed("component_purls", "purl_text", "catalogue"),
    parsed("(SELECT DISTINCT component_purl FROM findings)", "component_purl", "parsed_findings"),
    best("parsed_findings", "direct", "direct_quality", "direct_component"),
]

def upstream_version(t: str, v: str) -> str:
    marker = "(dfsg|really|ubuntu)"

    def clean(x: str) -> str:
        """Parts before the trailing run of marker parts, the last of them cut at a marker."""
        parts = f"string_split(trim({x}), '.')"
        run = f"len(list_filter(p[i:], lambda q: NOT regexp_matches(q, '^[+]?{marker}[^-]*$', 'i'))) = 0"
        kept = f"list_transform([{parts}], lambda p: array_to_string(p[1:coalesce(list_min(list_filter(range(1, len(p) + 1), lambda i: {run})), len(p) + 1) - 1], '.'))[1]"
        return f"nullif(trim(regexp_replace({kept}, '[+]?{marker}[^.-]*$', '', 'i'), '.'), '')"

    body = f"CASE WHEN contains({v}, ':') THEN substr({v}, strpos({v}, ':') + 1) ELSE {v} END"
    deb = clean(f"string_split({body}, '-')[1]")
    words = "string_split(d[-1], '.')"
    release = f"len(d) > 1 AND len({words}) > 1 AND regexp_full_match({words}[1], '[0-9]+') AND len(list_filter({words}, lambda w: NOT regexp_full_match(w, '[A-Za-z0-9_]+'))) = 0"
    rpm_body = f"list_transform([string_split({body}, '-')], lambda d: CASE WHEN {release} THEN array_to_string(d[1:-2], '-') ELSE array_to_string(d, '-') END)[1]"
    apk_body = f"CASE WHEN regexp_matches({v}, '-r[0-9]+$') THEN regexp_extract({v}, '^(.*)-r[0-9]+$', 1) ELSE {v} END"
    return f"""CASE {t} WHEN 'deb' THEN CASE WHEN NOT contains({deb}, '%') THEN {deb} END
      WHEN 'apk' THEN {clean(apk_body)} WHEN 'rpm' THEN {clean(rpm_body)} END"""


UPSTREAM = f"""upstreams AS (
  SELECT *, CASE WHEN contains(up, '%') THEN url_decode(up) ELSE up END AS up_text
  FROM (SELECT *, CASE WHEN ok AND type IN ('deb','apk','rpm') THEN {qualifier('upstream')} END AS up FROM direct))"""

IDENTITY = [
    *DIRECT, W.ALIASES, UPSTREAM,
    f"""asked_rows AS (
  SELECT *, coalesce(ok AND type IN ('deb','apk','rpm') AND direct_quality < 3, FALSE) AS asked,
    nullif(CASE WHEN ends_with(string_split(up_text, '@')[1], '.src.rpm')
      THEN regexp_replace(regexp_replace(string_split(up_text, '@')[1], '\\.src\\.rpm$', ''), '(-[0-9][^-]*)+$', '')
      ELSE trim(string_split(up_text, '@')[1]) END, '') AS up_name,
    nullif(trim(regexp_extract(up_text, '^[^@]*@(.*)$', 1)), '') AS up_version
  FROM upstreams),
alias_rows AS (
  SELECT a.*, CASE WHEN asked THEN up_name END AS source_name, al.status AS alias_status, al.component AS alias_component,
    coalesce(up_version, {upstream_version('type', "nullif(trim(version), '')")}) AS up_v
  FROM asked_rows a LEFT JOIN aliases al ON asked AND a.up_name = al.source_name),
identity_step AS (
  SELECT * EXCLUDE (up, up_text, up_name, up_version, up_v, alias_component, asked),
    CASE WHEN asked AND alias_status = 'definitive' THEN alias_component || '@' || up_v END AS mapped_text,
    CASE WHEN asked AND alias_status IS NULL THEN 'no_identity_mapping'
      WHEN asked AND alias_status = 'probable' THEN 'mapping_probable_only'
      WHEN asked AND alias_status = 'definitive' AND up_v IS NULL THEN 'version_underivable' END AS identity_refusal
  FROM alias_rows)""",
]

RESOLVED = [
    *IDENTITY,
    parsed("(SELECT component_purl, mapped_text FROM identity_step WHERE mapped_text IS NOT NULL)", "mapped_text", "mapped_parsed"),
    best("mapped_parsed", "mapped_best", "mapped_quality", "mapped_component"),
    """resolved_purls AS (
  SELECT i.component_purl, i.ok AS valid, i.type AS purl_type, i.direct_quality, i.source_name, i.alias_status,
    CASE WHEN m.component_purl IS NULL THEN i.direct_quality WHEN m.mapped_quality >= 3 THEN 4 ELSE m.mapped_quality END AS quality,
    CASE WHEN m.component_purl IS NULL THEN i.direct_component ELSE m.mapped_component END AS component,
    i.identity_refusal
  FROM identity_step i LEFT JOIN mapped_best m ON i.component_purl = m.component_purl)""",
]

OPEN = [
    *RESOLVED, W.ENTRIES, W.BENCHMARK_WORDS, W.ENTRY_SYMBOLS,
    """entry_facts AS (
  SELECT e.component, e.cve, CAST(count(s.symbol) FILTER (WHERE s.confidence = 'definitive') AS BIGINT) AS n_definitive,
    coalesce(bool_and(s.dynsym_export_verified) FILTER (WHERE s.confidence = 'definitive'), FALSE) AS all_exported
  FROM (SELECT DISTINCT component, cve FROM entries) e
  LEFT JOIN entry_symbols s ON e.component = s.component AND e.cve = s.cve GROUP BY e.component, e.cve),
resolved_findings AS (
  SELECT f.artifact_id, f.cve, f.component_purl, r.purl_type, r.quality, r.component, r.source_name, r.alias_status,
    r.direct_quality, e.n_definitive, e.all_exported, e.cve IS NOT NULL AS has_slice,
    CASE WHEN r.identity_refusal IS NOT NULL THEN r.identity_refusal
      WHEN r.quality <= 1 OR r.component IS NULL THEN 'purl_match_insufficient'
      WHEN e.cve IS NULL THEN 'manifest_no_entry'
      WHEN e.n_definitive = 0 THEN 'manifest_probable_only' END AS early_reason
  FROM findings f JOIN resolved_purls r ON f.component_purl = r.component_purl AND r.valid
  LEFT JOIN entry_facts e ON r.component = e.component AND f.cve = e.cve)""",
]

HITS = [
    W.COMPONENTS, W.BENCHMARK_WORDS, W.IDENTITY_SYMBOLS, W.IDENTITY_STRINGS, W.INVENTORIES, W.SYMBOLS, W.RO_STRINGS,
    """string_matches AS (
  SELECT DISTINCT r.artifact_id, r.inventory_id, p.pattern
  FROM (SELECT DISTINCT artifact_id, inventory_id, value FROM ro_strings) r
  JOIN (SELECT DISTINCT pattern FROM identity_strings) p ON regexp_matches(r.value, p.pattern)),
symbol_hits AS (
  SELECT artifact_id, inventory_id, component, 'symbol:' || symbol AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY artifact_id, inventory_id, component ORDER BY position, symbol) AS rn
    FROM (SELECT DISTINCT s.artifact_id, s.inventory_id, i.component, i.symbol, i.position
          FROM symbols s JOIN identity_symbols i ON s.normalized = i.symbol OR s.raw = i.symbol)) WHERE rn = 1),
string_hits AS (
  SELECT artifact_id, inventory_id, component, 'string:' || pattern AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY artifact_id, inventory_id, component ORDER BY position, pattern) AS rn
    FROM string_matches JOIN identity_strings USING (pattern)) WHERE rn = 1)""",
]

# The component list of DIRECT already defines `components`; keep one definition.
MEMBER_VIEWS = [
    """members AS (
  SELECT h.*, i.stripped, i.static_linked, i.has_dynamic FROM (
    SELECT *, 'symbol' AS kind FROM symbol_hits
    UNION ALL
    SELECT s.*, 'string' AS kind FROM string_hits s WHERE NOT EXISTS (
      SELECT 1 FROM symbol_hits y WHERE y.artifact_id = s.artifact_id AND y.inventory_id = s.inventory_id
        AND y.component = s.component)) h
  LEFT JOIN inventories i ON h.artifact_id = i.artifact_id AND h.inventory_id = i.inventory_id)""",
]
MEMBERS = [*HITS, *MEMBER_VIEWS]

FACT_VIEWS = [*HITS[2:], *MEMBER_VIEWS]

OBSERVED_VIEW = """observed_symbols AS (
  SELECT DISTINCT artifact_id, symbol FROM (SELECT artifact_id, raw AS symbol FROM symbols
    UNION ALL SELECT artifact_id, normalized FROM symbols)),
observed AS (
  SELECT w.artifact_id, w.component, w.cve,
    list_sort(coalesce(list(DISTINCT s.symbol) FILTER (WHERE o.symbol IS NOT NULL), [])) AS symbols_observed,
    list_sort(coalesce(list(DISTINCT s.symbol) FILTER (WHERE o.symbol IS NULL), [])) AS symbols_absent
  FROM (SELECT DISTINCT artifact_id, component, cve FROM resolved_findings WHERE has_slice) w
  JOIN entry_symbols s ON w.component = s.component AND w.cve = s.cve AND s.confidence = 'definitive'
  LEFT JOIN observed_symbols o ON o.artifact_id = w.artifact_id AND o.symbol = s.symbol
  GROUP BY w.artifact_id, w.component, w.cve)"""

OBSERVED = [*OPEN, W.INVENTORIES, W.SYMBOLS, OBSERVED_VIEW]

_LABELS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.QUALITY_LABELS.items())

DECISIONS = [
    *OPEN, *FACT_VIEWS, OBSERVED_VIEW,
    f"""usable AS (
  SELECT artifact_id, bool_or(format <> 'unknown' AND NOT (stripped AND static_linked)
    AND (has_dynamic OR (NOT stripped AND has_table))) AS any_usable FROM inventories GROUP BY artifact_id),
blocked AS (
  SELECT artifact_id, component, count(*) AS n_members,
    arg_min(flag, inventory_id) FILTER (WHERE flag IS NOT NULL) AS blocked_reason
  FROM (SELECT *, CASE WHEN stripped AND static_linked THEN 'stripped_static_binary'
          WHEN stripped AND NOT has_dynamic THEN 'stripped_insufficient_dynsym' END AS flag FROM members)
  GROUP BY artifact_id, component),
ruled AS (
  SELECT r.*, b.n_members, o.symbols_observed, o.symbols_absent,
    CASE WHEN early_reason IS NOT NULL THEN 'D03:' || early_reason
      WHEN NOT coalesce(u.any_usable, FALSE) THEN 'D03:symbol_table_unusable'
      WHEN c.provenance_status <> 'verified' THEN 'D03:provenance_unverified'
      WHEN b.blocked_reason IS NOT NULL THEN 'D03:' || b.blocked_reason
      WHEN b.n_members IS NULL AND r.quality = 2 THEN 'D03:identity_unverified'
      WHEN len(o.symbols_observed) > 0 THEN 'D04:'
      WHEN b.n_members IS NOT NULL AND NOT r.all_exported THEN 'D03:symbol_not_observable'
      WHEN b.n_members IS NOT NULL THEN 'D02:'
      WHEN coalesce(u.any_usable, FALSE) AND r.quality >= 3 THEN 'D01:'
      ELSE 'D03:default_insufficient' END AS outcome
  FROM resolved_findings r
  LEFT JOIN usable u ON r.artifact_id = u.artifact_id
  LEFT JOIN components c ON r.component = c.component
  LEFT JOIN blocked b ON r.artifact_id = b.artifact_id AND r.component = b.component
  LEFT JOIN observed o ON r.artifact_id = o.artifact_id AND r.component = o.component AND r.cve = o.cve),
decisions AS (
  SELECT artifact_id, cve, component_purl, purl_type, quality, component, source_name, alias_status, has_slice,
    n_members, symbols_observed, symbols_absent,
    substr(outcome, 1, 3) AS rule_id, nullif(substr(outcome, 5), '') AS reason_code,
    CASE substr(outcome, 1, 3) WHEN 'D04' THEN 'AFFECTED' WHEN 'D03' THEN 'UNDER_INVESTIGATION' ELSE 'NOT_AFFECTED' END AS verdict,
    CASE substr(outcome, 1, 3) WHEN 'D01' THEN 'component_not_present' WHEN 'D02' THEN 'vulnerable_code_not_present' END AS justification,
    replace(lower(cve), ':', '-') AS statement_id,
    CASE quality {_LABELS} END AS purl_match_quality
  FROM ruled)""",
]

_STAGE = " ".join(
    f"WHEN reason_code IN ({', '.join(repr(c) for c in codes)}) THEN '{stage}'" for stage, _, codes in V.STAGES)

STAGED = [
    *DECISIONS, W.ARTIFACTS,
    f"""staged AS (
  SELECT d.*, coalesce(a.class, 'unknown') AS class,
    CASE WHEN verdict IN ('NOT_AFFECTED','AFFECTED') THEN 'S7' {_STAGE} ELSE 'S?' END AS stage_id
  FROM decisions d LEFT JOIN artifacts a USING (artifact_id))""",
]

STAGE_ROWS = "stage_dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{stage}', '{name}')" for i, (stage, name, _) in enumerate(V.STAGES)) + ") v(ord, stage_id, stage_name))"
