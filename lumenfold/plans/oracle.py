"""The same queries in DuckDB's SQL, in other formulations: line tables and windows instead of arrays,
sequential CASEs over single patterns instead of alternations, boundary groups instead of look-around."""

from __future__ import annotations

import re

from ..functions import lexicon as X
from . import synth

LF = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def has(x: str, pattern: str) -> str:
    p, flags = (pattern[4:], "'i'") if pattern.startswith("(?i)") else (pattern, "''")
    return f"regexp_matches({x}, {q(p)}, {flags})"


def got(x: str, pattern: str, group: int = 0) -> str:
    p, flags = (pattern[4:], "'i'") if pattern.startswith("(?i)") else (pattern, "''")
    return f"CASE WHEN regexp_matches({x}, {q(p)}, {flags}) THEN regexp_extract({x}, {q(p)}, {group}, {flags}) END"


def any_part(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def begins(x: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in parts) + ")"


def in_list(parts) -> str:
    return "(" + ", ".join(q(p) for p in parts) + ")"


def cleaned(raw: str, max_chars: int | None = X.MAX_CHARS) -> str:
    x = raw
    for a, b in X.LIGATURES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    x = f"replace(replace(replace(nfc_normalize({x}), chr(160), ' '), chr(13) || {LF}, {LF}), chr(13), {LF})"
    x = f"regexp_replace({x}, '[{X.BULLETS}]', {LF} || '- ', 'g')"
    line = strip(r"regexp_replace(l, '[ \t]+', ' ', 'g')")
    x = f"array_to_string(list_transform(string_split({x}, {LF}), lambda l: {line}), {LF})"
    x = f"regexp_replace({x}, '\\n{{4,}}', {LF} || {LF} || {LF}, 'g')"
    return strip(x) if max_chars is None else f"left({strip(x)}, {max_chars})"


def _inline() -> str:
    cases = []
    for section, names in X.SECTIONS.items():
        for n in names:
            p = rf"^[\s#*=-]*(?:{n})[:\s|-]+(.+)$"
            tail = strip(f"regexp_extract(line, {q(p)}, 1, 'i')")
            cases.append(f"WHEN regexp_matches(line, {q(p)}, 'i') AND length({tail}) > 1 AND NOT regexp_full_match({tail}, '[:*=-]+') THEN {{'s': {q(section)}, 't': {tail}}}")
    return "CASE " + " ".join(cases) + " END"


def _alone() -> str:
    cases = [f"WHEN regexp_matches(bare, {q(rf'(^|[^a-z0-9_])(?:{n})([^a-z0-9_]|$)')}, 'i') THEN {q(section)}" for section, names in X.SECTIONS.items() for n in names]
    return "CASE WHEN length(bare) > 50 OR bare = '' THEN NULL " + " ".join(cases) + " END"


_BARE = strip(
    r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[\s#*=-]*', ''), '[\s:*=-]*$', ''), '^(?:\d+[\s.)|/-]+|//\s*)', ''), '[\[\]{}()]', ' ', 'g'), '\s+', ' ', 'g'))"
)
_ANY = "(" + "|".join(n for names in X.SECTIONS.values() for n in names).replace(r"\s", r"[\s\[\]{}()]") + ")"


def _heading_documents() -> str:
    """Runs of words of every line, at its start and anywhere in its bare form, joined with short first lines."""
    word, other = r"[\p{L}\p{M}\p{N}\p{Pc}]", r"[^\p{L}\p{M}\p{N}\p{Pc}]"
    spaced = lambda x: rf"regexp_replace({x}, '\s+', ' ', 'g')"
    lines = f"(SELECT doc_id, unnest(string_split(text, {LF})) AS l, unnest(range(len(string_split(text, {LF})))) AS line_no FROM documents)"
    return rf"""
WITH first AS (SELECT {strip(f"string_split(text, {LF})[1]")} AS name, source AS section, doc_id AS rank FROM documents),
names AS (SELECT core, min({{'rank': rank, 'section': section}}) AS h FROM (SELECT regexp_extract({spaced("lower(name)")}, '{word}(?:.*{word})?') AS core, section, rank FROM first WHERE length(name) <= 60)
  WHERE core <> '' GROUP BY core),
ls AS (SELECT doc_id, line_no, {strip("l")} AS line FROM {lines}),
forms AS (SELECT doc_id, line_no, 0 AS kind, regexp_replace(line, '^[\s#*=-]*', '') AS form FROM ls UNION ALL SELECT doc_id, line_no, 1, {_BARE} FROM ls WHERE length({_BARE}) <= 50),
cut AS (SELECT *, regexp_extract_all(lower(form), '{word}+{other}*') AS p FROM forms WHERE kind = 1 OR regexp_matches(form, '^{word}')),
starts AS (SELECT *, unnest(range(1, CASE kind WHEN 0 THEN 1 ELSE len(p) END + 1)) AS a FROM cut WHERE len(p) > 0),
grams AS (SELECT *, regexp_replace(array_to_string(p[a : a + n - 1], ''), '{other}+$', '') AS g FROM (SELECT *, unnest(range(1, least(30, len(p) - a + 1) + 1)) AS n FROM starts)),
hits AS (SELECT doc_id, line_no, kind, h.rank, h.section, CASE WHEN kind = 0 THEN regexp_extract(substr(form, length(g) + 1), '^[:\s|-]+(.+)$', 1) END AS tail FROM grams JOIN names ON core = {spaced("g")}),
best AS (SELECT doc_id, line_no, arg_min({{'section': section, 'tail': tail}}, {{'kind': kind, 'rank': rank}}) AS h FROM hits
  WHERE kind = 1 OR (length(tail) > 1 AND NOT regexp_full_match(tail, '[:*=-]+')) GROUP BY doc_id, line_no)
SELECT doc_id, line_no, h.section, h.tail FROM best"""


def _lines(name: str, source: str, text: str) -> str:
    """A CTE of the stripped, not blank lines of a text, numbered from 1."""
    return f"""{name} AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
  SELECT doc_id, {strip('l')} AS line, i FROM (SELECT doc_id, unnest(string_split({text}, {LF})) AS l, generate_subscripts(string_split({text}, {LF}), 1) AS i FROM {source})) WHERE line <> '')"""


def _skills(text: str, key: str, source: str, before: str, name: str) -> str:
    """A CTE (key, cat_no, skill, display) of the skills whose tokens stand in lower-case text."""
    hits = []
    for i, (_, names) in enumerate(X.SKILLS.items()):
        for s in names:
            hits.append(f"CASE WHEN regexp_matches(low, {q(rf'(^|[^\p{{L}}\p{{N}}_#+{before}]){re.escape(s)}($|[^\p{{L}}\p{{N}}_#+])')}) THEN {{'c': {i}, 's': {q(s)}, 'd': {q(X.display(s))}}} END")
    return f"""{name} AS (SELECT {key}, h.c AS cat_no, h.s AS skill, h.d AS display FROM (
  SELECT {key}, unnest(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)) AS h FROM (SELECT {key}, lower({text}) AS low FROM {source})))"""


_years = f"list_transform(regexp_extract_all(m, {q(X.YEAR)}, 1), lambda y: CAST(y AS INT))"
_trim = lambda x: f"trim({x}, ' |-–—,' || chr(9))"
_part = lambda x, sep, i: strip(f"string_split({x}, {q(sep)})[{i}]")
_bars = f"list_filter(list_transform(string_split(%s, '|'), lambda p: {strip('p')}), lambda p: p <> '')"
_dashes = f"list_filter(list_transform(string_split(%s, ' - '), lambda p: {strip('p')}), lambda p: p <> '')"
_school = lambda x: any_part(f"lower({x})", X.SCHOOLS)


def _title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '[\p{{L}}]+|[^\p{{L}}]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"


_degree = "coalesce(" + ", ".join(got("line", "(?i)" + d) for d in X.DEGREES) + ")"
_rounded = lambda x: f"CAST(format('{{:.1f}}', {x}) AS DOUBLE)"

CTES: dict[str, str] = {
    "raw": f"raw AS ({synth.RESUMES})",
    "norm": f"norm AS (SELECT doc_id, {cleaned('raw_text')} AS clean FROM raw)",
    "ls": _lines("ls", "norm", "clean"),
    "alls": f"alls AS (SELECT doc_id, unnest(string_split(clean, {LF})) AS line, generate_subscripts(string_split(clean, {LF}), 1) AS i FROM norm)",
    "heads": f"""heads AS (SELECT doc_id, i, line, CASE WHEN NOT regexp_matches(line, {q(_ANY)}, 'i') THEN NULL WHEN inl IS NOT NULL THEN inl.s ELSE {_alone()} END AS section, inl.t AS tail
  FROM (SELECT *, CASE WHEN regexp_matches(line, {q(_ANY)}, 'i') THEN {_inline()} END AS inl, {_BARE} AS bare FROM alls))""",
    "filled": "filled AS (SELECT *, max(CASE WHEN section IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head_at FROM heads)",
    "parts": f"""parts AS (SELECT doc_id, head_at, max(section) AS section, {strip(f"string_agg(CASE WHEN i = head_at THEN tail ELSE line END, {LF} ORDER BY i)")} AS content
  FROM filled WHERE head_at IS NOT NULL GROUP BY doc_id, head_at)""",
    "secs": f"secs AS (SELECT doc_id, section, string_agg(content, {LF} || {LF} ORDER BY head_at) AS content FROM parts WHERE content <> '' GROUP BY doc_id, section)",
    "wide": "wide AS (SELECT n.doc_id, clean, "
    + ", ".join(f"max(content) FILTER (WHERE section = '{s}') AS {s}" for s in X.SECTIONS)
    + " FROM norm n LEFT JOIN secs s ON s.doc_id = n.doc_id GROUP BY n.doc_id, clean)",
    "sk": _skills("clean", "doc_id", "norm", ".", "sk"),
    "own": "own AS (SELECT n.doc_id, coalesce(list_sort(list(DISTINCT display) FILTER (WHERE display IS NOT NULL)), []) AS skills FROM norm n LEFT JOIN sk ON sk.doc_id = n.doc_id GROUP BY n.doc_id)",
    "xl": _lines("xl", "wide", "coalesce(experience, clean)"),
    "dated": f"dated AS (SELECT *, {got('line', X.DATES)} AS m, sum(CASE WHEN {has('line', X.DATES)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS job_no FROM xl)",
    "jobrows": f"""jobrows AS (SELECT doc_id, job_no, y[1] AS start_year, coalesce(y[2], {X.REFERENCE_YEAR}) AS end_year, {any_part('lower(m)', X.OPEN_ENDED)} AS open,
    coalesce(CASE WHEN contains(h, '|') THEN {_bars % 'h'}[1] WHEN contains(h, ' at ') THEN {_part('h', ' at ', 1)} WHEN contains(h, ' - ') THEN {_part('h', ' - ', 1)} WHEN h <> '' THEN h END, 'Professional Role') AS role,
    coalesce(CASE WHEN contains(h, '|') THEN {_bars % 'h'}[2] WHEN contains(h, ' at ') THEN {_part('h', ' at ', 2)} WHEN contains(h, ' - ') THEN {_part('h', ' - ', 2)} END, 'Company') AS company
  FROM (SELECT doc_id, job_no, m, {_years} AS y, CASE WHEN b <> '' THEN b ELSE a END AS h FROM (
    SELECT doc_id, job_no, m, {_trim('left(line, instr(line, m) - 1)')} AS b, {_trim('substr(line, instr(line, m) + length(m))')} AS a FROM dated WHERE m IS NOT NULL)))""",
    "points": f"""points AS (SELECT doc_id, job_no, n, p AS point FROM (SELECT doc_id, job_no, n, ltrim(line, '-*•– ' || chr(9)) AS p FROM dated
  WHERE m IS NULL AND job_no > 0 AND {begins('line', ('-', '*', '•', '–'))}) WHERE p <> '')""",
    "years": "years AS (SELECT doc_id, CAST(greatest(1, max(greatest(start_year, end_year)) - min(least(start_year, end_year))) AS DOUBLE) AS total FROM jobrows GROUP BY doc_id)",
    "el": _lines("el", "wide", "coalesce(education, clean)"),
    "edu": f"""edu AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, {got('line', X.YEAR, 1)} AS graduation_year, coalesce({_title(_degree)}, part, {q(X.NO_DEGREE)}) AS degree, place AS institution FROM (
    SELECT *, CASE WHEN contains(line, '|') AND len(bars) >= 2 THEN CASE WHEN {_school('bars[2]')} AND NOT {_school('bars[1]')} THEN bars[2] ELSE bars[1] END
                   WHEN NOT contains(line, '|') AND contains(line, ' - ') AND len(dashes) >= 2 THEN dashes[1] ELSE line END AS place,
              CASE WHEN contains(line, '|') AND len(bars) >= 2 THEN CASE WHEN {_school('bars[2]')} AND NOT {_school('bars[1]')} THEN bars[1] ELSE bars[2] END
                   WHEN NOT contains(line, '|') AND contains(line, ' - ') AND len(dashes) >= 2 THEN dashes[2] END AS part
    FROM (SELECT *, {_bars % 'line'} AS bars, {_dashes % 'line'} AS dashes FROM el WHERE {_school('line')} OR {' OR '.join(has('line', '(?i)' + d) for d in X.DEGREES)})))""",
    "names": f"""names AS (SELECT doc_id, arg_min(b, n) AS name FROM (SELECT doc_id, n, line, {strip(f"regexp_replace(line, {q(X.HONORIFIC[4:])}, '', 'i')")} AS b FROM ls WHERE n <= 10)
  WHERE NOT {any_part('lower(line)', X.CONTACT_MARKS)} AND lower(line) NOT IN {in_list(X.NOT_NAMES)} AND NOT {begins('lower(line)', ('curriculum vitae', 'page '))}
    AND len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 4 AND regexp_matches(b, {q(X.NAME)})
    AND NOT (NOT regexp_matches(b, '\\s') AND b = lower(b) AND b <> upper(b)) GROUP BY doc_id)""",
    "cities": f"cities AS (SELECT doc_id, arg_min({strip(got('line', X.CITY, 1))}, n) AS city FROM ls WHERE n <= 8 AND {has('line', X.CITY)} AND NOT {any_part('lower(line)', X.NO_CITY)} GROUP BY doc_id)",
    "contacts": f"""contacts AS (SELECT n.doc_id, name, {got('clean', X.EMAIL)} AS email,
    CASE WHEN {has('clean', X.PHONE_LABELLED)} THEN {strip(got('clean', X.PHONE_LABELLED, 1))}
         WHEN length(regexp_replace({got('clean', X.PHONE)}, '\\D', '', 'g')) >= 8 THEN {strip(got('clean', X.PHONE))} END AS phone,
    CASE WHEN {has('clean', X.LOCATION_LABELLED)} THEN {strip(got('clean', X.LOCATION_LABELLED, 1))} ELSE city END AS location,
    {got('clean', X.LINKEDIN)} AS linkedin, {got('clean', X.GITHUB)} AS github
  FROM norm n LEFT JOIN names ON names.doc_id = n.doc_id LEFT JOIN cities ON cities.doc_id = n.doc_id)""",
    "jobs": f"jobs AS (SELECT job_id, title, {strip('jd_text')} AS jd FROM ({synth.JOB_TABLE}))",
    "jsk": _skills("jd", "job_id", "jobs", "", "jsk"),
    "asks": f"""asks AS (SELECT j.job_id, jd, jd = '' AS blank, coalesce(list(DISTINCT skill) FILTER (WHERE skill IS NOT NULL), []) AS need,
    coalesce(CAST({got('jd', X.REQUIRED_YEARS, 1)} AS DOUBLE), 3.0) AS years, {any_part('lower(jd)', ('ph.d', 'doctorate'))} AS phd, {any_part('lower(jd)', ('master', 'm.s.', 'mba'))} AS master
  FROM jobs j LEFT JOIN jsk ON jsk.job_id = j.job_id GROUP BY j.job_id, jd)""",
    "matched": "matched AS (SELECT doc_id, job_id, list_sort(list(d)) AS matched FROM (SELECT o.doc_id, job_id, unnest(skills) AS d, need FROM own o, asks) WHERE list_contains(need, lower(d)) GROUP BY doc_id, job_id)",
    "missing": "missing AS (SELECT doc_id, a.job_id, list_sort(list(display)) AS missing FROM own o, (SELECT DISTINCT job_id, skill, display FROM jsk) a WHERE NOT list_contains(list_transform(skills, lambda s: lower(s)), skill) GROUP BY doc_id, a.job_id)",
    "held": f"""held AS (SELECT doc_id, count(*) AS n_edu, arg_min(institution, n) AS first_place, {any_part("string_agg(lower(degree || ' ' || institution), ' ' ORDER BY n)", ('ph.d', 'doctorate'))} AS phd,
    {any_part("string_agg(lower(degree || ' ' || institution), ' ' ORDER BY n)", ('master', 'm.s', 'm.tech', 'mba'))} AS master,
    {any_part("string_agg(lower(degree || ' ' || institution), ' ' ORDER BY n)", ('bachelor', 'b.s', 'b.tech', 'b.e', 'degree'))} AS bachelor FROM edu GROUP BY doc_id)""",
    "pairs": f"""pairs AS (SELECT o.doc_id, a.job_id, blank, skills, need, coalesce(m.matched, []) AS matched, coalesce(x.missing, []) AS missing, a.years AS need_years, coalesce(y.total, 0.0) AS own_years,
    a.phd AS ask_phd, a.master AS ask_master, coalesce(h.phd, false) AS phd, coalesce(h.master, false) AS master, coalesce(h.bachelor, false) AS bachelor, coalesce(n_edu, 0) AS n_edu, first_place,
    c.name, c.email IS NOT NULL AND c.phone IS NOT NULL AS reach, c.linkedin IS NOT NULL OR c.github IS NOT NULL AS links, EXISTS (SELECT 1 FROM points p WHERE p.doc_id = o.doc_id) AS pts
  FROM own o CROSS JOIN asks a LEFT JOIN matched m ON m.doc_id = o.doc_id AND m.job_id = a.job_id LEFT JOIN missing x ON x.doc_id = o.doc_id AND x.job_id = a.job_id
  LEFT JOIN years y ON y.doc_id = o.doc_id LEFT JOIN held h ON h.doc_id = o.doc_id LEFT JOIN contacts c ON c.doc_id = o.doc_id)""",
    "marks": f"""marks AS (SELECT *, CASE WHEN len(need) = 0 THEN CASE WHEN len(skills) > 0 THEN 75.0::DOUBLE ELSE 40.0::DOUBLE END
      ELSE {_rounded('least(100.0::DOUBLE, len(matched)::DOUBLE / len(need) * 100.0::DOUBLE + least(10.0::DOUBLE, len(skills) * 0.5::DOUBLE))')} END AS s_skill,
    {_rounded('least(100.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN own_years >= need_years THEN 90.0::DOUBLE + least(10.0::DOUBLE, (own_years - need_years) * 2) WHEN own_years > 0 THEN own_years / need_years * 85.0::DOUBLE ELSE 50.0::DOUBLE END))')} AS s_exp,
    CAST(CASE WHEN ask_phd THEN CASE WHEN phd THEN 100 WHEN master THEN 75 ELSE 60 END
         WHEN ask_master THEN CASE WHEN phd OR master THEN 100 WHEN bachelor THEN 80 ELSE 65 END
         ELSE CASE WHEN phd OR master OR bachelor THEN 95 WHEN n_edu > 0 THEN 85 ELSE 70 END END AS DOUBLE) AS s_edu,
    CAST(70 + 10 * (reach::INT + links::INT + pts::INT) AS DOUBLE) AS s_quality FROM pairs)""",
    "totals": f"""totals AS (SELECT *, CASE WHEN blank THEN 50.0::DOUBLE ELSE {_rounded('s_skill * 0.4::DOUBLE + s_exp * 0.35::DOUBLE + s_edu * 0.15::DOUBLE + s_quality * 0.1::DOUBLE')} END AS overall FROM marks)""",
    "pages": f"pages_in AS ({synth.PAGES})",
    "labelled": f"""labelled AS (SELECT *, CASE WHEN {strip('page')} = '' THEN 'other'
      WHEN {' OR '.join(has('lower(page)', p) for p in X.COVER_LETTER)} THEN 'cover_letter' WHEN {' OR '.join(has('lower(page)', p) for p in X.TRANSCRIPT)} THEN 'transcripts'
      WHEN {' OR '.join(has('lower(page)', p) for p in X.JOB_POSTING)} THEN 'job_description' WHEN {' OR '.join(has('lower(page)', p) for p in X.RESUME)} THEN 'resume'
      WHEN {has('page', X.EMAIL)} AND {has('page', X.PAGE_PHONE)} THEN 'resume' ELSE 'other' END AS category,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS p, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM pages_in)""",
    "islands": """islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS seg FROM (
    SELECT *, CASE WHEN lag(category) OVER (PARTITION BY doc_id ORDER BY p) = category THEN 0 ELSE 1 END AS new FROM labelled))""",
    "segs": f"""segs AS (SELECT doc_id, seg, max(category) AS category, min(p) AS start_page, max(p) AS end_page, string_agg(page, {LF} || {LF} ORDER BY p) AS text, max(n_pages) AS n_pages FROM islands GROUP BY doc_id, seg)""",
}
_NEEDS = list(CTES)


def with_ctes(*names: str, select: str) -> str:
    """select after the CTEs named and all that stand before the last of them (unused ones cost nothing)."""
    last = max(_NEEDS.index(n) for n in names)
    pages = {"pages", "labelled", "islands", "segs"}
    used = [n for n in _NEEDS[: last + 1] if (n in pages) == (names[0] in pages)]
    return "WITH " + ",\n".join(CTES[n] for n in used) + "\n" + select


_J = lambda x: f"array_to_string({x}, '|')"
_pct = "'(' || format('{:.1f}', overall) || '%)'"

_recommended = f"""SELECT doc_id, job_id, CASE WHEN blank THEN 'No job description provided for comparison. Displaying candidate profile only.'
  WHEN overall >= 75 THEN w || ' is a high-confidence match ' || {_pct} || ' for this role. Possesses strong alignment with core requirements (' || array_to_string(m[1:3], ', ') || '). Recommended to advance immediately to technical interview.'
  WHEN overall >= 50 THEN w || ' is a potential candidate ' || {_pct} || CASE WHEN len(missing) > 0 THEN ', though lacks explicit mention of ' || array_to_string(missing[1:2], ', ') ELSE '' END || '. Recommended for an initial recruiter screening call to clarify experience depth.'
  ELSE w || ' has significant skill or experience gaps for this specific position ' || {_pct} || '. Recommend reviewing alternative roles or junior positions.' END AS recommendation
  FROM (SELECT *, coalesce(name, 'The candidate') AS w, CASE WHEN len(need) = 0 THEN skills[1:5] ELSE matched END AS m FROM totals)"""

SQL: dict[str, str] = {
    "norm_basic": f"SELECT doc_id, clean AS clean_text, len(list_filter(string_split_regex(clean, '\\s+'), lambda w: w <> ''))::INT AS word_count, length(clean)::INT AS char_count FROM (SELECT doc_id, {cleaned('text', None)} AS clean FROM documents)",
    "norm_resumes": with_ctes("norm", select="SELECT doc_id, clean AS clean_text, len(list_filter(string_split_regex(clean, '\\s+'), lambda w: w <> ''))::INT AS word_count, length(clean)::INT AS char_count FROM norm"),
    "section_lines": with_ctes("heads", select="SELECT doc_id, section, count(*) AS n_headers, count(tail) AS n_inline FROM heads WHERE section IS NOT NULL GROUP BY doc_id, section"),
    "section_assemble": with_ctes("secs", select="SELECT doc_id, section, content FROM secs"),
    "section_table": with_ctes("secs", select="SELECT doc_id, section, content FROM secs"),
    "heading_rows": with_ctes("heads", select="SELECT doc_id, i - 1 AS line_no, section, tail FROM heads WHERE section IS NOT NULL"),
    "heading_documents": _heading_documents(),
    "name": with_ctes("contacts", select="SELECT doc_id, name FROM contacts"),
    "email": with_ctes("contacts", select="SELECT doc_id, email FROM contacts"),
    "email_documents": f"SELECT doc_id, {got('text', X.EMAIL)} AS email FROM documents",
    "phone": with_ctes("contacts", select="SELECT doc_id, phone FROM contacts"),
    "links": with_ctes("contacts", select="SELECT doc_id, linkedin, github FROM contacts"),
    "location": with_ctes("contacts", select="SELECT doc_id, location FROM contacts"),
    "skills_flat": with_ctes("own", select=f"SELECT doc_id, {_J('skills')} AS skills FROM own"),
    "skills_by_category": with_ctes("sk", select="SELECT doc_id, CASE cat_no " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(X.SKILLS)) + " END AS category, array_to_string(list_sort(list(display)), '|') AS skills FROM sk GROUP BY doc_id, cat_no"),
    "skill_frequency": with_ctes("own", select="SELECT skill, count(*) AS n_docs FROM (SELECT unnest(skills) AS skill FROM own) GROUP BY skill"),
    "domain": with_ctes("own", select="SELECT doc_id, CASE " + " ".join(f"WHEN len(list_intersect(list_transform(skills, lambda s: lower(s)), {list(names)})) > 0 THEN {q(label)}" for label, names in X.DOMAINS) + f" ELSE {q(X.OTHER_DOMAIN)} END AS primary_domain FROM own"),
    "exp_rows": with_ctes("jobrows", select="SELECT doc_id, CAST(job_no AS INT) AS seq, role, company, CAST(start_year AS STRING) AS start_date, CASE WHEN open THEN 'Present' ELSE CAST(end_year AS STRING) END AS end_date, CAST(greatest(1, end_year - start_year) AS STRING) || ' years' AS duration FROM jobrows"),
    "exp_highlights": with_ctes("points", select="SELECT doc_id, CAST(job_no AS INT) AS seq, string_agg(point, '|' ORDER BY n) AS highlights FROM points GROUP BY doc_id, job_no"),
    "exp_total": with_ctes("years", select="SELECT n.doc_id, total AS total_experience_years FROM norm n LEFT JOIN years y ON y.doc_id = n.doc_id"),
    "edu_rows": with_ctes("edu", select="SELECT doc_id, CAST(n AS INT) AS seq, institution, degree, graduation_year FROM edu"),
    "projects_top5": "WITH " + ",\n".join([*[CTES[n] for n in _NEEDS[: _NEEDS.index("wide") + 1]], _lines("pl", "wide", "projects")]) + f"\nSELECT doc_id, CAST(k AS INT) AS seq, left(line, 50) AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM pl WHERE length(line) > 5 AND NOT {begins('line', ('-', '*', '•'))}) WHERE k <= 5",
    "certs_top6": "WITH " + ",\n".join([*[CTES[n] for n in _NEEDS[: _NEEDS.index("wide") + 1]], _lines("cl", "wide", "certifications")]) + "\nSELECT doc_id, CAST(k AS INT) AS seq, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (SELECT doc_id, n, ltrim(line, '-*• ' || chr(9)) AS name FROM cl) WHERE length(name) BETWEEN 4 AND 80) WHERE k <= 6",
    "summary": with_ctes("wide", select="") + ",\n" + _lines("sl", "wide", "clean") + f"\nSELECT w.doc_id, coalesce(summary, f) AS summary FROM wide w LEFT JOIN (SELECT doc_id, arg_min(line, n) AS f FROM sl WHERE n BETWEEN 2 AND 6 AND len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) >= 15 AND NOT {begins('line', ('-', '*', '•'))} GROUP BY doc_id) s ON s.doc_id = w.doc_id",
    "skill_match": with_ctes("totals", select=f"SELECT doc_id, job_id, {_J('matched')} AS matched, {_J('missing')} AS missing FROM totals WHERE len(need) > 0"),
    "skill_missing": with_ctes("totals", select="SELECT job_id, skill, count(*) AS n_docs FROM (SELECT job_id, unnest(missing) AS skill FROM totals) GROUP BY job_id, skill"),
    "skill_score": with_ctes("totals", select="SELECT doc_id, job_id, s_skill AS score FROM totals WHERE NOT blank"),
    "exp_score": with_ctes("totals", select="SELECT doc_id, job_id, s_exp AS score FROM totals WHERE NOT blank"),
    "edu_score": with_ctes("totals", select="SELECT doc_id, job_id, s_edu AS score FROM totals WHERE NOT blank"),
    "quality_score": with_ctes("totals", select="SELECT doc_id, job_id, s_quality AS score FROM totals WHERE NOT blank"),
    "overall": with_ctes("totals", select="SELECT doc_id, job_id, overall AS overall_score FROM totals"),
    "match_level": with_ctes("totals", select="SELECT doc_id, job_id, CASE WHEN blank THEN 'Neutral' WHEN overall >= 75 THEN 'Strong Match' WHEN overall >= 50 THEN 'Potential Match' ELSE 'Weak Match' END AS match_level FROM totals"),
    "strengths": with_ctes("totals", select=f"""SELECT t.doc_id, job_id, {_J("CASE WHEN len(s) > 0 THEN s ELSE ['Candidate demonstrates baseline professional competencies.'] END")} AS strengths FROM (
  SELECT t.doc_id, t.job_id, list_filter([CASE WHEN len(matched) >= 3 THEN 'Strong match on core tech stack: ' || array_to_string(matched[1:4], ', ') || '.' END,
    CASE WHEN own_years >= 4 THEN 'Solid career experience (' || format('{{:.0f}}', own_years) || '+ years) in ' || d.primary_domain || '.' END,
    CASE WHEN s_edu >= 90 AND n_edu > 0 THEN 'Verified academic degree: ' || first_place || '.' END], lambda x: x IS NOT NULL) AS s
  FROM (SELECT * REPLACE (CASE WHEN len(need) = 0 THEN skills[1:5] ELSE matched END AS matched) FROM totals WHERE NOT blank) t
  JOIN (SELECT doc_id, CASE {' '.join(f"WHEN len(list_intersect(list_transform(skills, lambda s: lower(s)), {list(names)})) > 0 THEN {q(label)}" for label, names in X.DOMAINS)} ELSE {q(X.OTHER_DOMAIN)} END AS primary_domain FROM own) d ON d.doc_id = t.doc_id) t"""),
    "gaps": with_ctes("totals", select=f"""SELECT doc_id, job_id, {_J("CASE WHEN len(s) > 0 THEN s ELSE ['No critical qualification gaps identified.'] END")} AS gaps FROM (
  SELECT doc_id, job_id, list_filter([CASE WHEN len(missing) > 0 THEN 'Missing mentions of key technologies: ' || array_to_string(missing[1:4], ', ') || '.' END,
    CASE WHEN s_exp < 70 THEN 'Years of experience may be below target requirements.' END,
    CASE WHEN NOT links THEN 'No LinkedIn or GitHub profile links provided for verification.' END], lambda x: x IS NOT NULL) AS s FROM totals WHERE NOT blank)"""),
    "recommendation": with_ctes("totals", select=_recommended),
    "candidate_job_rank": with_ctes("totals", select="SELECT job_id, doc_id, overall_score, rank FROM (SELECT job_id, doc_id, overall AS overall_score, CAST(row_number() OVER (PARTITION BY job_id ORDER BY overall DESC, doc_id) AS INT) AS rank FROM totals) WHERE rank <= 10"),
    "page_classify": with_ctes("labelled", select="SELECT doc_id, CAST(p AS INT) AS page_no, category FROM labelled"),
    "packet_merge": with_ctes("segs", select="SELECT doc_id, CAST(seg AS INT) AS seg_no, category, CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page, CASE WHEN n_pages = 1 THEN 0.95::DOUBLE ELSE 0.88::DOUBLE END AS confidence FROM segs"),
    "packet_primary": with_ctes("segs", select=f"""SELECT doc_id, count(*) > 1 AS is_packet, coalesce(max(category) FILTER (WHERE category = 'resume'), arg_min(category, seg)) AS primary_category,
  md5(coalesce(string_agg(text, {LF} || {LF} ORDER BY seg) FILTER (WHERE category = 'resume' AND n_pages > 1), string_agg(text, {LF} || {LF} ORDER BY seg))) AS primary_md5 FROM segs GROUP BY doc_id"""),
    "segment_preview": with_ctes("segs", select="SELECT doc_id, CAST(seg - 1 AS INT) AS seg_no, category, left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM segs"),
    "block_layout": f"""WITH b AS (SELECT *, CASE WHEN x0 < 0.25 * page_width AND x1 > 0.65 * page_width THEN 's' WHEN x1 <= 0.48 * page_width THEN 'l' WHEN x0 >= 0.35 * page_width THEN 'r' ELSE 's' END AS band
  FROM ({synth.BLOCKS}) WHERE block_type = 0 AND {strip('text')} <> ''),
w AS (SELECT *, count(*) FILTER (WHERE band = 'l') OVER p AS nl, count(*) FILTER (WHERE band = 'r') OVER p AS nr, min(y0) FILTER (WHERE band <> 's') OVER p AS top, max(y1) FILTER (WHERE band <> 's') OVER p AS bottom FROM b WINDOW p AS (PARTITION BY doc_id, page)),
o AS (SELECT *, CASE WHEN nl < 2 OR nr < 2 THEN 0 WHEN band = 's' AND y1 <= top + 20 THEN 1 WHEN band = 's' AND y0 >= bottom - 20 THEN 5 WHEN band = 's' THEN 2 WHEN band = 'l' THEN 3 ELSE 4 END AS part FROM w)
SELECT doc_id, page, string_agg({strip('text')}, {LF} || {LF} ORDER BY part, CASE WHEN part IN (0, 2) THEN 0 ELSE y0 END, CASE WHEN part IN (0, 2) THEN 0 ELSE x0 END, block_no) AS text FROM o GROUP BY doc_id, page""",
    "scanned_flag": f"SELECT doc_id, coalesce(sum(length({strip('page')})) < {X.SCANNED_BELOW}, false) AS is_scanned FROM ({synth.SCANS}) GROUP BY doc_id",
    "ext_gate": f"""SELECT doc_id, filename, CASE WHEN trim(filename) = '' THEN '400 missing filename' WHEN NOT regexp_matches(lower(filename), '\\.(pdf|docx|txt)$') THEN '415 unsupported file type' WHEN size > {X.MAX_BYTES} THEN '413 file too large' END AS reject_reason FROM ({synth.FILES})""",
    "reconcile_scalar": with_ctes("contacts", select=f"""SELECT n.doc_id, CASE WHEN e.name IS NULL OR lower(e.name) IN ('full name', 'candidate', 'name', '') THEN c.name ELSE e.name END AS name,
  CASE WHEN e.email <> '' AND contains(lower(n.clean), lower(e.email)) THEN e.email ELSE c.email END AS email, coalesce(nullif(e.phone, ''), c.phone) AS phone,
  CASE WHEN e.years > 0 THEN e.years ELSE y.total END AS total_experience_years, CASE WHEN e.doc_id IS NULL THEN 'heuristic' ELSE 'hybrid' END AS extraction_mode
  FROM norm n JOIN contacts c ON c.doc_id = n.doc_id LEFT JOIN ({synth.EXTERNAL}) e ON e.doc_id = n.doc_id LEFT JOIN years y ON y.doc_id = n.doc_id"""),
    "reconcile_skills": with_ctes("own", select=f"""SELECT doc_id, coalesce(string_agg(s, '|' ORDER BY s), '') AS skills FROM (SELECT n.doc_id, arg_min(trim(u.s), u.i) AS s FROM norm n LEFT JOIN (
  SELECT doc_id, unnest(string_split(skills, '|')) AS s, generate_subscripts(string_split(skills, '|'), 1) AS i FROM ({synth.EXTERNAL})
  UNION ALL SELECT doc_id, unnest(skills) AS s, 1000 + generate_subscripts(skills, 1) AS i FROM own) u ON u.doc_id = n.doc_id AND trim(u.s) <> '' GROUP BY n.doc_id, lower(u.s)) GROUP BY doc_id"""),
}
_cat = "CASE cat_no " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(X.SKILLS)) + " END"
SQL["reconcile_categories"] = with_ctes("sk", select=f"""SELECT coalesce(o.doc_id, e.doc_id) AS doc_id, coalesce(o.category, 'Languages') AS category,
  array_to_string(CASE WHEN e.s IS NULL THEN o.s WHEN o.s IS NULL THEN e.s ELSE e.s || list_filter(o.s, lambda x: NOT list_contains(list_transform(e.s, lambda y: lower(y)), lower(x))) END, '|') AS skills
  FROM (SELECT doc_id, {_cat} AS category, list_sort(list(display)) AS s FROM sk GROUP BY doc_id, cat_no) o
  FULL JOIN (SELECT doc_id, string_split(skills, '|') AS s FROM ({synth.EXTERNAL}) WHERE skills <> '') e ON e.doc_id = o.doc_id AND o.category = 'Languages'""")
SQL["prompt_budget"] = with_ctes("norm", select="SELECT doc_id, least(length(clean), 14000)::INT AS n_chars FROM norm")
SQL["page_preview"] = with_ctes("labelled", select=f"SELECT doc_id, CAST(p AS INT) AS page_no, {strip('left(page, 800)')} AS preview FROM labelled")
SQL["score_band"] = with_ctes("totals", select="""SELECT doc_id, job_id, upper(left(array_to_string(list_transform(list_filter(string_split_regex(coalesce(name, 'Candidate Profile'), '\\s+'), lambda w: w <> ''), lambda w: left(w, 1)), ''), 2)) AS initials,
  CASE WHEN floor(overall + 0.5) >= 75 THEN 'high' WHEN floor(overall + 0.5) >= 50 THEN 'mid' ELSE 'low' END AS band FROM totals""")
SQL["analyze"] = with_ctes("totals", select=f"""SELECT t.doc_id, t.job_id, j.title, overall AS overall_score,
  CASE WHEN blank THEN 'Neutral' WHEN overall >= 75 THEN 'Strong Match' WHEN overall >= 50 THEN 'Potential Match' ELSE 'Weak Match' END AS match_level,
  CASE WHEN blank THEN 50.0 ELSE s_skill END::DOUBLE AS technical_skills_score, CASE WHEN blank THEN 50.0 ELSE s_exp END::DOUBLE AS experience_score,
  CASE WHEN blank THEN 50.0 ELSE s_edu END::DOUBLE AS education_score, CASE WHEN blank THEN 50.0 ELSE s_quality END::DOUBLE AS quality_score, r.recommendation
  FROM totals t JOIN jobs j ON j.job_id = t.job_id JOIN ({_recommended}) r ON r.doc_id = t.doc_id AND r.job_id = t.job_id""")
SQL["reconcile_lists"] = with_ctes("edu", select=f"""SELECT n.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN e.role ELSE coalesce(j.roles, '') END AS roles, CASE WHEN e.school <> '' THEN e.school ELSE coalesce(d.places, '') END AS schools
  FROM norm n LEFT JOIN ({synth.LISTS}) e ON e.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, string_agg(role, '|' ORDER BY job_no) AS roles FROM jobrows GROUP BY doc_id) j ON j.doc_id = n.doc_id
  LEFT JOIN (SELECT doc_id, string_agg(institution, '|' ORDER BY n) AS places FROM edu GROUP BY doc_id) d ON d.doc_id = n.doc_id""")
SQL["packet_external"] = with_ctes("segs", select=f"""SELECT * FROM (
  SELECT s.doc_id, CASE WHEN n_pages = 1 THEN 'direct_single_page' ELSE 'heuristic_boundary' END AS engine, count(*) OVER (PARTITION BY s.doc_id) > 1 AS is_packet, CAST(seg AS INT) AS seg_no, category,
    CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page, CASE WHEN n_pages = 1 THEN 0.95::DOUBLE ELSE 0.88::DOUBLE END AS confidence, md5(text) AS text_md5
  FROM segs s LEFT JOIN ({synth.CUTS}) c ON c.doc_id = s.doc_id WHERE n_pages = 1 OR coalesce(n_cuts, 0) = 0
  UNION ALL
  SELECT r.doc_id, 'external', n_cuts > 1, k, CASE k WHEN 1 THEN 'resume' ELSE 'other' END, a, b, 0.95::DOUBLE, md5(coalesce(string_agg(page, {LF} || {LF} ORDER BY p), ''))
  FROM (SELECT doc_id, n_cuts, k::INT AS k, CASE k WHEN 1 THEN 1 ELSE first_end + 1 END::INT AS a, CASE k WHEN 1 THEN first_end ELSE first_end + 1 END::INT AS b FROM ({synth.CUTS}), range(1, 3) t(k) WHERE k <= n_cuts) r
  LEFT JOIN labelled l ON l.doc_id = r.doc_id AND l.p BETWEEN a AND b
  WHERE (SELECT max(n_pages) FROM labelled x WHERE x.doc_id = r.doc_id) > 1 GROUP BY r.doc_id, n_cuts, k, a, b)""")
SQL["pdf_text"] = r"""SELECT doc_id, 1::INT AS page_count, length(t)::INT AS n_shown, md5(t) AS shown_md5, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT doc_id, regexp_replace(text, '[^\x21-\x7E\x{A1}-\x{FFFF}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)"""
SQL["files_by_path"] = r"""WITH d AS (SELECT doc_id, doc_id % 16 AS k, text, lang, source FROM documents WHERE text IS NOT NULL),
kinds AS (SELECT *, CASE WHEN k % 4 = 2 AND NOT regexp_matches(text, '[\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]') AND lang IS NOT NULL AND source IS NOT NULL THEN 'docx' WHEN k = 3 THEN 'broken' WHEN k = 7 THEN 'exe' WHEN k % 4 = 3 THEN 'pdf' ELSE 'txt' END AS kind FROM d),
t AS (SELECT doc_id, kind, CASE WHEN kind IN ('broken', 'exe') THEN NULL WHEN kind = 'docx' THEN text || lang || '|' || source ELSE text END AS t FROM kinds)
SELECT doc_id, CASE kind WHEN 'broken' THEN 'docx' ELSE kind END AS file_type, CASE WHEN t IS NOT NULL THEN 1 END::INT AS page_count,
  length(regexp_replace(t, '[^\x21-\x7E\x{A1}-\x{FFFF}]', '', 'g'))::INT AS n_shown, md5(regexp_replace(t, '[^\x21-\x7E\x{A1}-\x{FFFF}]', '', 'g')) AS shown_md5,
  CASE kind WHEN 'broken' THEN '422' WHEN 'exe' THEN '415' END AS error FROM t"""
SQL["json_commits"] = "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN NULL ELSE source END AS source, md5(CASE WHEN lang = 'en' THEN upper(source) ELSE text END) AS text_md5 FROM documents"
SQL["packet_rows"] = SQL["packet_external"]
SQL["skills_table"] = SQL["skills_flat"]
SQL["dictionary_hits"] = r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+ \p{L}+')) AS name FROM benchmark),
d AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[\p{L}\p{N}_#+]+[^\p{L}\p{N}_#+]*') AS ps FROM documents),
p AS (SELECT doc_id, low, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM d),
g AS (SELECT doc_id, piece || regexp_extract(lead(piece) OVER w, '^[\p{L}\p{N}_#+]+') AS name, coalesce(lag(piece) OVER w, regexp_extract(low, '^[^\p{L}\p{N}_#+]*')) AS gap FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n_names, md5(string_agg(name, '|' ORDER BY name)) AS names_md5 FROM (SELECT DISTINCT doc_id, name FROM g JOIN n USING (name) WHERE NOT ends_with(gap, '.')) GROUP BY doc_id"""
_reply = lambda p, f: f"nullif(CASE WHEN json_valid({p}.reply) THEN json_extract_string({p}.reply, '{f}') END, '')"
_known = lambda p: f"coalesce(CASE WHEN json_valid({p}.reply) THEN json_exists({p}.reply, '$.contact') END, false)"
SQL["provider_priority"] = with_ctes("contacts", select=f"""SELECT n.doc_id, coalesce(CASE WHEN lower({_reply('a', '$.contact.name')}) <> 'candidate' THEN {_reply('a', '$.contact.name')} END, CASE WHEN lower({_reply('b', '$.contact.name')}) <> 'candidate' THEN {_reply('b', '$.contact.name')} END, c.name) AS name,
  coalesce({_reply('a', '$.contact.phone')}, {_reply('b', '$.contact.phone')}, c.phone) AS phone, coalesce({_reply('b', '$.contact.location')}, c.location) AS location,
  coalesce({_reply('a', '$.total_experience_years')}::DOUBLE, {_reply('b', '$.total_experience_years')}::DOUBLE, y.total) AS total_experience_years,
  array_to_string(list_filter([CASE WHEN {_known('a')} THEN 'alpha' END, CASE WHEN {_known('b')} THEN 'beta' END], lambda x: x IS NOT NULL), '|') AS providers, CASE WHEN {_known('a')} OR {_known('b')} THEN 'hybrid' ELSE 'heuristic' END AS extraction_mode
  FROM norm n JOIN contacts c ON c.doc_id = n.doc_id LEFT JOIN years y ON y.doc_id = n.doc_id
  LEFT JOIN (SELECT * FROM ({synth.REPLIES}) WHERE provider = 'alpha') a ON a.doc_id = n.doc_id LEFT JOIN (SELECT * FROM ({synth.REPLIES}) WHERE provider = 'beta') b ON b.doc_id = n.doc_id""")
SQL["provider_errors"] = f"SELECT provider, '422 not a profile' AS error, count(*) AS n_replies, min(doc_id) AS first_doc FROM ({synth.REPLIES}) r WHERE NOT {_known('r')} GROUP BY provider"
SQL["layer_metrics"] = with_ctes("norm", select=f"""SELECT i::INT AS layer_no, layer, n_rows::BIGINT AS n_rows, 0::BIGINT AS n_errors, 0::BIGINT AS n_scanned, n_chars::BIGINT AS n_chars FROM (
  SELECT 0 AS i, 'ingestion' AS layer, count(*) AS n_rows, sum(length(raw_text)) AS n_chars FROM raw UNION ALL SELECT 1, 'normalisation', count(*), sum(length(clean)) FROM norm
  UNION ALL SELECT 2, 'extraction', count(*), sum(length(clean)) FROM norm UNION ALL SELECT 3, 'scoring', count(*) * {len(synth.JOB_ROWS)}, sum(length(clean)) * {len(synth.JOB_ROWS)} FROM norm)""")
SQL["jd_skills"] = f"""WITH posts AS (SELECT job_id, {strip('jd_text')} AS jd FROM ({synth.POSTS})), {_skills('jd', 'job_id', 'posts', '', 'psk')}
SELECT p.job_id, coalesce(string_agg(DISTINCT skill, '|' ORDER BY skill), '') AS skills, coalesce(max(CAST({got('jd', X.REQUIRED_YEARS, 1)} AS DOUBLE)), 3.0::DOUBLE) AS required_years,
  array_to_string(list_filter(string_split_regex(coalesce(max({strip(got('jd', X.TITLE, 1))}), ''), '\\s+'), lambda w: w <> ''), '|') AS title_words,
  bool_or({any_part('lower(jd)', ('ph.d', 'doctorate'))}) AS phd, bool_or({any_part('lower(jd)', ('master', 'm.s.', 'mba'))}) AS master FROM posts p LEFT JOIN psk ON psk.job_id = p.job_id GROUP BY p.job_id"""
SQL["capabilities"] = f"""SELECT format, count(*) AS n_files, count(*) FILTER (WHERE format IN {in_list(X.SUFFIXES)} AND trim(filename) <> '' AND size <= {X.MAX_BYTES}) AS n_taken, 'healthy' AS status, 'heuristic' AS mode, {X.REFERENCE_YEAR}::INT AS reference_year,
  'ingestion|segmentation|normalisation|extraction|scoring' AS layers, format IN {in_list(X.SUFFIXES)} AS supported FROM (SELECT *, lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS format FROM ({synth.FILES})) GROUP BY format"""
SQL["text_decode"] = f"SELECT doc_id, name AS text FROM ({synth.BYTES})"
SQL["json_roundtrip"] = with_ctes("contacts", select=f"""SELECT n.doc_id, c.name, c.email, y.total AS total_experience_years, {_J('o.skills')} AS skills, CAST(NULL AS VARCHAR) AS error
  FROM norm n JOIN contacts c ON c.doc_id = n.doc_id JOIN own o ON o.doc_id = n.doc_id LEFT JOIN years y ON y.doc_id = n.doc_id""")
_dom = "CASE " + " ".join(f"WHEN len(list_intersect(list_transform(o.skills, lambda s: lower(s)), {list(names)})) > 0 THEN {q(label)}" for label, names in X.DOMAINS) + f" ELSE {q(X.OTHER_DOMAIN)} END"
SQL["profile_core"] = with_ctes("contacts", select=f"""SELECT n.doc_id, c.name, c.email, y.total AS total_experience_years, {_dom} AS primary_domain, {_J('o.skills')} AS skills,
  (SELECT count(*) FROM jobrows j WHERE j.doc_id = n.doc_id)::INT AS n_experience, (SELECT count(*) FROM edu e WHERE e.doc_id = n.doc_id)::INT AS n_education,
  left(clean, 300) || CASE WHEN length(clean) > 300 THEN '...' ELSE '' END AS preview, 'heuristic' AS extraction_mode
  FROM norm n JOIN contacts c ON c.doc_id = n.doc_id JOIN own o ON o.doc_id = n.doc_id LEFT JOIN years y ON y.doc_id = n.doc_id""")
_whole = lambda x: f"format('{{:.0f}}', {x})"
_ratio = "len(matched)::DOUBLE / greatest(len(need), 1) * 100"
_neutral = lambda x: f"CASE WHEN blank THEN 'Job description not provided.' ELSE {x} END"
_unless = lambda x: f"CASE WHEN blank THEN '' ELSE {x} END"
SQL["category_texts"] = with_ctes("totals", select=f"""SELECT t.doc_id, t.job_id,
  {_neutral(f"CASE WHEN len(need) = 0 THEN 'Few specific technical keywords identified in job description.' ELSE 'Candidate matches ' || len(matched) || ' of ' || len(need) || ' required technical skills (' || {_whole(_ratio)} || '%).' END")} AS technical_skills_text,
  {_neutral(f"CASE WHEN own_years >= need_years THEN 'Candidate has ' || format('{{:.1f}}', own_years) || ' years of experience, exceeding the required ' || {_whole('need_years')} || ' years.' WHEN own_years > 0 THEN 'Candidate has ' || format('{{:.1f}}', own_years) || ' years vs. ' || {_whole('need_years')} || ' required years (' || {_whole('own_years / need_years * 100')} || '% match).' ELSE 'Experience duration could not be accurately calculated from resume dates.' END")} AS experience_text,
  {_neutral('''CASE WHEN ask_phd AND phd THEN 'Candidate holds required doctoral degree.' WHEN ask_phd AND master THEN 'Candidate holds Master''s degree (Ph.D. preferred).' WHEN ask_phd THEN 'Candidate lacks required doctoral degree.'
    WHEN ask_master AND (phd OR master) THEN 'Candidate holds required advanced degree.' WHEN ask_master AND bachelor THEN 'Candidate holds Bachelor''s degree (Master''s preferred).' WHEN ask_master THEN 'Advanced degree not explicitly stated.'
    WHEN phd OR master OR bachelor THEN 'Candidate possesses relevant higher education credentials.' WHEN n_edu > 0 THEN 'Candidate possesses educational background.' ELSE 'No formal degree detected in resume.' END''')} AS education_text,
  {_neutral("CASE WHEN reach OR links OR pts THEN array_to_string(list_filter([CASE WHEN reach THEN 'Complete contact info' END, CASE WHEN links THEN 'Professional profile links provided' END, CASE WHEN pts THEN 'Structured accomplishment highlights present' END], lambda x: x IS NOT NULL), ', ') ELSE 'Standard resume structure.' END")} AS quality_text,
  {_unless(_J('CASE WHEN len(need) = 0 THEN skills[1:5] ELSE matched END'))} AS technical_skills_matches,
  {_unless("coalesce(CASE WHEN a.title = '' THEN first_roles ELSE titled END, '')")} AS experience_matches, {_unless("coalesce(held_list, '')")} AS education_matches,
  {_unless("array_to_string(list_filter([CASE WHEN reach THEN 'Complete contact info' END, CASE WHEN links THEN 'Professional profile links provided' END, CASE WHEN pts THEN 'Structured accomplishment highlights present' END], lambda x: x IS NOT NULL), '|')")} AS quality_matches,
  {_unless(_J('missing'))} AS technical_skills_missing, {_unless("CASE WHEN own_years < need_years THEN format('{:.1f}', need_years - own_years) || ' more years required' ELSE '' END")} AS experience_missing,
  {_unless("CASE WHEN s_edu < 80 THEN 'Higher degree preferred' ELSE '' END")} AS education_missing, '' AS quality_missing
  FROM totals t JOIN (SELECT job_id, coalesce({strip(got('jd', X.TITLE, 1))}, '') AS title FROM jobs) a ON a.job_id = t.job_id
  LEFT JOIN (SELECT doc_id, string_agg(role, '|' ORDER BY job_no) FILTER (WHERE k <= 2) AS first_roles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY job_no) AS k FROM jobrows) GROUP BY doc_id) f ON f.doc_id = t.doc_id
  LEFT JOIN (SELECT doc_id, job_id, string_agg(role, '|' ORDER BY job_no) AS titled FROM jobrows, (SELECT job_id, list_filter(string_split_regex(lower(coalesce({strip(got('jd', X.TITLE, 1))}, '')), '\\s+'), lambda w: w <> '') AS ws FROM jobs) w
    WHERE len(list_filter(ws, lambda x: contains(lower(role), x))) > 0 GROUP BY doc_id, job_id) m ON m.doc_id = t.doc_id AND m.job_id = t.job_id
  LEFT JOIN (SELECT doc_id, string_agg(degree || ' from ' || institution, '|' ORDER BY n) AS held_list FROM edu GROUP BY doc_id) e ON e.doc_id = t.doc_id""")
# CTEs that follow another select's need the comma first
SQL["summary"] = SQL["summary"].replace("\n,\n", ",\n", 1)
