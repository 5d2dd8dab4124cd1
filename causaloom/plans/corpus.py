"""Corpus layer: cleaning, filters, keys, enrichment, deduplication."""

from __future__ import annotations

from ..functions import vocab
from .registry import fixture, operator

#: The fixture corpus has no English causal marker; its own frequent words stand in.
FIXTURE_MARKER = r"(?i)(?:^|[ \n])(?:that the|of the|de la|in der|de las)(?:[ \n]|$)"


@fixture
def filtered(d):
    return f"""SELECT record_id, source, text, date, tail, wc, source_rank, CASE WHEN wc = 0 THEN 'empty' WHEN wc < 30 THEN 'short(<30w)' WHEN NOT {d.rlike('text', FIXTURE_MARKER)} THEN 'no_causal_marker' ELSE 'keep' END AS reason FROM corpus"""


@operator
def quality_filter(d):
    return "SELECT record_id, source, wc FROM filtered WHERE reason = 'keep'"


@operator
def drop_reasons(d):
    return "SELECT record_id, source, reason FROM filtered WHERE reason <> 'keep'"


@operator
def filter_stats(d):
    return """SELECT source, count(*) AS loaded, count(*) FILTER (WHERE reason = 'empty') AS empty, count(*) FILTER (WHERE reason = 'short(<30w)') AS short, count(*) FILTER (WHERE reason = 'no_causal_marker') AS no_causal, count(*) FILTER (WHERE reason = 'keep') AS kept FROM filtered GROUP BY source"""


@operator
def extraction_input(d):
    """Records with supervision and 200 to 2000 words, with why others are skipped."""
    return "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_structured' WHEN c.wc < 200 THEN 'too_short' WHEN c.wc > 2000 THEN 'too_long' ELSE 'keep' END AS reason FROM corpus c LEFT JOIN labels l ON l.doc_id = c.record_id) t GROUP BY reason"


@operator
def word_range(d):
    return "SELECT record_id, wc FROM corpus WHERE wc BETWEEN 30 AND 2000"


@operator
def has_cause(d):
    return "SELECT ev_id, max(CASE WHEN cause_factor IN ('C', 'F') THEN 1 ELSE 0 END) = 1 AS has_cause FROM findings GROUP BY ev_id"


@operator
def tsb_eligible(d):
    """Conversations with one speaker role at least, two or more turns and enough words."""
    return f"""SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND count(DISTINCT role) <= 2 AND sum(CASE WHEN length(trim(text)) = 0 THEN 0 ELSE {d.size(d.words('text'))} END) BETWEEN 20 AND 2000"""


@operator
def candidate_quotes(d):
    """Distinct lines that hold a capitalised pair."""
    lines = d.explode + "(" + ("split(text, '\\n')" if d.name == "spark" else "string_split(text, chr(10))") + ")"
    return f"SELECT DISTINCT line FROM (SELECT {lines} AS line FROM documents) t WHERE {d.rlike('line', '[A-Z][a-z]+ [A-Z][a-z]+')}"


@operator
def enrich_structured(d):
    """Events with their nested children as ordered text."""
    child = d.joined(f"concat(cause_factor, ':', description, ':', CAST(persons AS {d.S}))", "pos", "|")
    return f"SELECT s.ev_id, s.damage, s.fatal, coalesce(f.children, '') AS children, coalesce(f.n, 0) AS n_findings FROM structured s LEFT JOIN (SELECT ev_id, {child} AS children, count(*) AS n FROM findings GROUP BY ev_id) f ON s.ev_id = f.ev_id"


@operator
def supervision_source(d):
    """Where supervision comes from: the first source that knows the record."""
    return """SELECT o_orderkey AS ev_id, CASE WHEN o_orderkey % 4 = 3 THEN CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' ELSE 'none' END WHEN f.ev_id IS NOT NULL THEN 'findings' WHEN c.c_custkey IS NOT NULL THEN 'customer' ELSE 'none' END AS supervision
    FROM orders LEFT JOIN (SELECT DISTINCT ev_id FROM findings WHERE cause_factor = 'C') f ON f.ev_id = o_orderkey LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 0"""


@operator
def code_lookup(d):
    """Codes to meanings; a later table overrides an earlier one unless blank."""
    return f"""SELECT a.code, coalesce(nullif(b.meaning, ''), a.meaning) AS meaning FROM (SELECT n_nationkey AS code, n_name AS meaning FROM nation) a
    LEFT JOIN (SELECT r_regionkey AS code, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS meaning FROM region) b ON a.code = b.code"""


@operator
def fuzzy_key_resolution(d):
    """Keys in three tiers: listed, by a shared date and a name within the text if only one fits, else missing."""
    return """WITH q AS (SELECT c_custkey, c_nationkey, c_name FROM customer), m AS (
      SELECT q.c_custkey, min(s.s_suppkey) AS s_suppkey, count(*) AS n FROM q JOIN supplier s ON s.s_nationkey = q.c_nationkey AND strpos(q.c_name, substr(s.s_name, -2)) > 0 GROUP BY q.c_custkey)
    SELECT q.c_custkey, CASE WHEN q.c_custkey % 3 = 0 THEN 'listing' WHEN m.n = 1 THEN 'fuzzy' ELSE 'missing' END AS tier, CASE WHEN q.c_custkey % 3 = 0 THEN q.c_custkey WHEN m.n = 1 THEN m.s_suppkey END AS key
    FROM q LEFT JOIN m ON m.c_custkey = q.c_custkey""".replace("strpos(q.c_name, substr(s.s_name, -2)) > 0", "instr(q.c_name, substr(s.s_name, -2)) > 0")


@operator
def injury_rollup(d):
    """Persons by injury level, zero-filled."""
    levels = (("fatal", "R"), ("serious", "A"), ("minor", "N"))
    return "SELECT ev_id, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN persons END), 0) AS BIGINT) AS {n}" for n, f in levels) + " FROM findings GROUP BY ev_id"


@operator
def primary_cause(d):
    """The first finding flagged C or F; without one the subject of the first sequence entry flagged C, else null."""
    return """SELECT coalesce(f.ev_id, s.ev_id) AS ev_id, CASE WHEN f.flagged > 0 THEN f.description ELSE s.subject END AS primary_cause
    FROM (SELECT ev_id, count(*) FILTER (WHERE upper(cause_factor) IN ('C', 'F')) AS flagged, min_by(description, pos) FILTER (WHERE upper(cause_factor) IN ('C', 'F')) AS description FROM findings GROUP BY ev_id) f
    FULL OUTER JOIN (SELECT ev_id, nullif(min_by(subject, pos) FILTER (WHERE upper(cause_factor) = 'C'), '') AS subject FROM coded_sequence GROUP BY ev_id) s ON f.ev_id = s.ev_id"""


@operator
def supervision_coverage(d):
    return "SELECT c.source, count(*) AS n, count(l.doc_id) AS with_structured, count(*) FILTER (WHERE l.quality = 1) AS with_primary FROM corpus c LEFT JOIN labels l ON l.doc_id = c.record_id GROUP BY c.source"


@operator
def longest_per_id(d):
    """The longest text of each id, ties by id."""
    return "SELECT grp, record_id, wc FROM (SELECT record_id % 50 AS grp, record_id, wc, row_number() OVER (PARTITION BY record_id % 50 ORDER BY wc DESC, record_id) AS rn FROM corpus) t WHERE rn = 1"


@operator
def source_union(d):
    """Two sources under one projection."""
    return f"SELECT concat('C', CAST(c_custkey AS {d.S})) AS record_id, 'customer' AS source, c_name AS title, c_nationkey AS place FROM customer UNION ALL SELECT concat('S', CAST(s_suppkey AS {d.S})), 'supplier', s_name, s_nationkey FROM supplier"


@operator
def normalize_text(d):
    """Cleaning chain without the compatibility normalisation (see ``clean_text``)."""
    x = d.replace_all("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    x = f"replace({x}, {'decode(unhex(\'C2AD\'), \'UTF-8\')' if d.name == 'spark' else 'chr(173)'}, '')"
    x = d.replace_all(x, r"-\n([A-Za-z0-9_])", "$1")
    x = d.replace_all(x, r"[\r\n\t]", " ")
    x = d.replace_all(d.replace_all(x, vocab.HEADER_FRAGMENTS, " "), vocab.PAGE_ARTIFACTS, " ")
    x = d.replace_all(x, r"\s+", " ")
    return f"SELECT doc_id, trim({x}) AS clean FROM documents"


@operator
def causal_marker(d):
    text = "concat(event_type, CASE event_id % 4 WHEN 0 THEN ' because of it' WHEN 1 THEN ' due to wind' WHEN 2 THEN ' while cruising' ELSE ' quietly' END)"
    return f"SELECT event_id, {d.rlike(text, vocab.CAUSAL_PATTERN)} AS has_link FROM events"


@fixture
def raw_dates(d):
    """Dates in the forms that sources use."""
    s = d.S
    dd, mm, yy = "lpad(CAST(1 + event_id % 28 AS {s}), 2, '0')".format(s=s), "lpad(CAST(1 + event_id % 12 AS {s}), 2, '0')".format(s=s), "CAST(1950 + event_id % 75 AS {s})".format(s=s)
    return f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat({yy}, '-', {mm}, '-', {dd}, ' 00:00') WHEN 1 THEN concat({yy}, {mm}, {dd}) WHEN 2 THEN concat({dd}, '/', {mm}, '/', {yy}) WHEN 3 THEN concat({mm}, '/', {dd}, '/', substr({yy}, 3, 2), ' 10:00:00') WHEN 4 THEN '' ELSE 'unknown' END AS raw FROM events"""


@operator
def normalize_date(d):
    """YYYYMMDD or ''; nn/nn/nnnn is day first, nn/nn/nn month first with a pivot at 50."""
    raw = "trim(raw)"
    return f"""SELECT event_id, CASE WHEN {d.rlike(raw, r'^\d{4}-\d{2}-\d{2}')} THEN concat(substr({raw}, 1, 4), substr({raw}, 6, 2), substr({raw}, 9, 2)) WHEN {d.rlike(raw, r'^\d{8}$')} THEN {raw}
      WHEN {d.rlike(raw, r'^\d{2}/\d{2}/\d{4}')} THEN concat(substr({raw}, 7, 4), substr({raw}, 4, 2), substr({raw}, 1, 2))
      WHEN {d.rlike(raw, r'^\d{2}/\d{2}/\d{2}')} THEN concat(CASE WHEN {d.try_int(f"substr({raw}, 7, 2)")} >= 50 THEN '19' ELSE '20' END, substr({raw}, 7, 2), substr({raw}, 1, 2), substr({raw}, 4, 2)) ELSE '' END AS date FROM raw_dates"""


@operator
def report_date(d):
    """M/D/YYYY to ISO, month first."""
    return f"""SELECT event_id, CASE WHEN {d.rlike('raw', r'^\d{1,2}/\d{1,2}/\d{4}')} THEN concat({d.extract('raw', r'^\d{1,2}/\d{1,2}/(\d{4})')}, '-', lpad({d.extract('raw', r'^(\d{1,2})/')}, 2, '0'), '-', lpad({d.extract('raw', r'^\d{1,2}/(\d{1,2})/')}, 2, '0')) ELSE raw END AS iso FROM raw_dates"""


@fixture
def tail_texts(d):
    s = d.S
    return f"SELECT c_custkey, concat('seen N', CAST(c_custkey AS {s}), 'AB near C-FABC and G-WXYZ then JA', CAST(1000 + c_custkey % 500 AS {s}), ' and C-FABC again', CASE WHEN c_custkey % 2 = 0 THEN ' EC-XYZ' ELSE '' END) AS t FROM customer"


@operator
def extract_tails(d):
    """All registration marks in pattern order, upper-cased, each once at its first place."""
    parts = d.extract_all("t", vocab.TAIL_PATTERNS[0])
    for p in vocab.TAIL_PATTERNS[1:]:
        parts = d.concat_arrays(parts, d.extract_all("t", p))
    return f"SELECT c_custkey, {d.join_array(d.distinct('marks'))} AS tails FROM (SELECT c_custkey, {d.transform(parts, 'm', 'upper(m)')} AS marks FROM tail_texts) x"


@operator
def normalize_tail(d):
    raw = f"concat(' n', CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END, CAST(c_custkey AS {d.S}), ' a ')"
    t = f"replace(upper(trim({raw})), ' ', '')"
    return f"SELECT c_custkey, CASE WHEN {d.rlike(t, '^N0[0-9]')} THEN concat('N', substr({t}, 3)) ELSE {t} END AS tail FROM customer"


@operator
def accident_id(d):
    text = f"concat('case ', CASE WHEN o_orderkey % 3 = 0 THEN 'ANC' WHEN o_orderkey % 3 = 1 THEN 'WPR' ELSE 'xx' END, lpad(CAST(o_orderkey % 100 AS {d.S}), 2, '0'), 'FA', lpad(CAST(o_orderkey % 1000 AS {d.S}), 3, '0'), ' closed')"
    return f"SELECT o_orderkey, nullif({d.extract(text, vocab.ACCIDENT_ID)}, '') AS accident_id FROM orders"


@operator
def report_type(d):
    """Report type from its URL, prefixes in order."""
    u = f"concat('/reports/', CASE o_orderkey % 9 WHEN 0 THEN 'AAR' WHEN 1 THEN 'AAB' WHEN 2 THEN 'SIR' WHEN 3 THEN 'AIR' WHEN 4 THEN 'ASR' WHEN 5 THEN 'SRR' WHEN 6 THEN 'SS' WHEN 7 THEN 'SR' ELSE 'XX' END, lpad(CAST(o_orderkey % 100 AS {d.S}), 4, '0'), '.pdf')"
    name = d.extract("u", r"/([A-Z]+[0-9]+)\.pdf$")
    return f"""SELECT o_orderkey, n AS number, CASE WHEN n LIKE 'AAR%' THEN 'AAR' WHEN n LIKE 'AAB%' THEN 'AAB' WHEN n LIKE 'SIR%' THEN 'SIR' WHEN n LIKE 'AIR%' THEN 'AIR' WHEN n LIKE 'ASR%' THEN 'ASR' WHEN n LIKE 'SRR%' THEN 'SRR' WHEN n LIKE 'SS%' THEN 'SS' WHEN n LIKE 'SR%' THEN 'SRR' ELSE 'OTHER' END AS type
    FROM (SELECT o_orderkey, {name} AS n FROM (SELECT o_orderkey, {u} AS u FROM orders) a) b"""


@operator
def source_rank(d):
    return "SELECT record_id, CASE WHEN source_rank = 0 THEN 0 WHEN source_rank = 1 THEN 1 WHEN source_rank = 2 THEN 2 WHEN source_rank < 8 THEN 3 WHEN source_rank < 14 THEN 4 ELSE 5 END AS rank FROM corpus"


@operator
def faa_severity(d):
    return "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'fatal' WHEN o_orderstatus = 'F' THEN 'accident' WHEN o_orderstatus = 'O' THEN 'incident' END AS severity FROM orders"


@operator
def categorize(d):
    """Category of an event: its first mapped occurrence code, else the first code, the finding category, or the source."""
    whens = " ".join(f"WHEN {code} THEN '{cat}'" for code, cat in vocab.OCCURRENCE_CATEGORY.items())
    return f"""WITH f AS (SELECT ev_id, pos, (l_partkey % 62) * 10 AS code, category_no FROM findings), m AS (SELECT ev_id, pos, code, category_no, CASE code {whens} END AS cat FROM f),
    a AS (SELECT ev_id, min_by(cat, CASE WHEN cat IS NULL THEN pos + 1000 ELSE pos END) AS cat, min_by(CASE WHEN pos = 1 AND code > 0 THEN code END, pos) AS first_code, min_by(category_no, pos) AS category_no FROM m GROUP BY ev_id)
    SELECT o_orderkey AS ev_id, coalesce(a.cat, concat('OTHER:NTSB-', CAST(a.first_code AS {d.S})), concat('HFACS_CAT_', a.category_no), concat('UNCATEGORIZED:', o_orderstatus)) AS category
    FROM orders LEFT JOIN a ON a.ev_id = o_orderkey""".replace("concat('OTHER:NTSB-', CAST(a.first_code AS", "('OTHER:NTSB-' || CAST(a.first_code AS").replace("concat('HFACS_CAT_', a.category_no)", "('HFACS_CAT_' || a.category_no)")


@operator
def resolve_severity(d):
    return """SELECT ev_id, CASE WHEN fatal > 15 THEN 'fatal' WHEN serious > 4 THEN 'serious_injury' WHEN minor > 1 THEN 'minor_injury' WHEN damage IN ('DEST', 'SUBS', 'MINR', 'MIN') THEN 'aircraft_damage_only' WHEN fatal IS NOT NULL THEN 'no_damage_or_injury' ELSE 'unknown' END AS severity FROM structured"""


@operator
def gold_severity(d):
    return "SELECT ev_id, CASE WHEN fatal IS NULL THEN NULL WHEN fatal > 15 THEN 'fatal' WHEN serious > 4 THEN 'serious_injury' WHEN minor > 1 THEN 'minor_injury' ELSE 'aircraft_damage_only' END AS severity FROM structured"


@operator
def cause_strings(d):
    """Findings flagged C or F, then the subjects of sequence entries flagged C with their modifier."""
    text = d.joined("cause", "part, pos", "|")
    return f"""SELECT ev_id, {text} AS causes, count(*) AS n FROM (
      SELECT ev_id, 0 AS part, pos, description AS cause FROM findings WHERE upper(cause_factor) IN ('C', 'F') AND description <> ''
      UNION ALL SELECT ev_id, 1 AS part, pos, CASE WHEN coalesce(modifier, '') IN ('', 'None') THEN subject ELSE concat(subject, ' (', modifier, ')') END AS cause FROM coded_sequence WHERE upper(cause_factor) = 'C' AND subject <> '') c GROUP BY ev_id"""


@operator
def factor_strings(d):
    text = d.joined("CASE WHEN l_linestatus = 'O' THEN concat(subject, ' (', description, ')') ELSE subject END", "pos", "|")
    return f"SELECT ev_id, {text} AS factors FROM findings WHERE cause_factor = 'F' GROUP BY ev_id"


@operator
def finding_group(d):
    """Group by code, or by the first group with a keyword in the text."""
    has = "instr(t, '{}') > 0"
    whens = " ".join("WHEN " + " OR ".join(has.format(k) for k in words) + f" THEN '{group}'" for group, words in vocab.FINDING_KEYWORDS)
    codes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FINDING_CODES.items())
    words = "CASE l_partkey % 8 WHEN 0 THEN 'PILOT MISJUDGED' WHEN 1 THEN 'ENGINE OIL' WHEN 2 THEN 'WIND GUSTS' WHEN 3 THEN 'COMPANY TRAINING' WHEN 4 THEN 'MAINTENANCE OF ENGINE' ELSE upper(description) END"
    return f"SELECT by_code, by_keyword, count(*) AS n FROM (SELECT coalesce(CASE category_no {codes} END, 'none') AS by_code, CASE {whens} ELSE 'unclassified' END AS by_keyword FROM (SELECT category_no, {words} AS t FROM findings) f) g GROUP BY by_code, by_keyword"


@operator
def supervision_block(d):
    """Coded causes, occurrences, sequence entries (at most thirty), findings (at most fifteen), injuries and damage of an event as the lines of a prompt.

    Events without a cause, a sequence and findings have no block.  An event that only
    ``coded_sequence`` or ``findings`` know has no cause, injury and damage lines.
    """
    flag = "CASE WHEN trim(coalesce(cause_factor, '')) = '' THEN '-' ELSE trim(cause_factor) END"
    entry = f"CASE WHEN pos <= 30 AND trim(subject) NOT IN ('', 'None') THEN concat('  [occ ', coalesce(CAST(occurrence AS {d.S}), '?'), '] [', {flag}, '] ', trim(subject), CASE WHEN trim(coalesce(modifier, '')) = '' THEN '' ELSE concat(' - ', trim(modifier)) END) END"
    finding = f"CASE WHEN pos <= 15 THEN concat('  [', {flag}, '] ', coalesce(nullif(trim(description), ''), '?')) END"
    place = f"concat('  ', CAST(pos AS {d.S}), '. ', coalesce(nullif(trim(code_text), ''), '?'), CASE WHEN trim(coalesce(phase_text, '')) = '' THEN '' ELSE concat(' (phase: ', trim(phase_text), ')') END)"
    br = "chr(10)"

    def part(title, line, most, what, rows):
        more = f"CASE WHEN count(*) > {most} THEN concat({br}, '  ... (', CAST(count(*) - {most} AS {d.S}), ' more {what} omitted)') ELSE '' END" if most else "''"
        listed = d.joined(line, "pos", "#BR#")
        return f"SELECT ev_id, concat('{title}:', CASE WHEN coalesce({listed}, '') = '' THEN '' ELSE concat({br}, {listed}) END, {more}) AS lines FROM {rows} GROUP BY ev_id".replace("'#BR#'", br)

    def after(x):
        return f"CASE WHEN {x} IS NULL THEN '' ELSE concat({br}, {x}) END"

    def said(title, x):
        return f"CASE WHEN {x} IS NULL THEN '' ELSE concat({br}, '{title}: ', {x}) END"

    def some(x):
        return f"nullif(trim({x}), '')"

    hurt = f"CASE WHEN fatal IS NULL AND serious IS NULL AND minor IS NULL AND unhurt IS NULL THEN NULL ELSE concat('Injury: ', {', '.join(f"CAST(coalesce({c}, 0) AS {d.S}), ' {name}{sep}'" for c, name, sep in (('fatal', 'fatal', ', '), ('serious', 'serious', ', '), ('minor', 'minor', ', '), ('unhurt', 'none', '')))}) END"
    return f"""WITH entry_lines AS ({part('Sequence of events', entry, 30, 'entries', 'coded_sequence')}), finding_lines AS ({part('Findings', finding, 15, 'findings', 'findings')}),
    place_lines AS ({part('Occurrences', place, 0, '', 'occurrences')}),
    coded AS (SELECT coalesce(a.ev_id, b.ev_id) AS ev_id, a.lines AS entry_part, b.lines AS finding_part FROM entry_lines a FULL OUTER JOIN finding_lines b ON a.ev_id = b.ev_id),
    whole AS (SELECT ev_id, {some('primary_cause_text')} AS first_cause, {some('secondary_cause_text')} AS second_cause, {hurt} AS hurt, {some('damage')} AS damage FROM structured)
    SELECT coalesce(w.ev_id, c.ev_id) AS ev_id, concat('STRUCTURED FINDINGS (official investigation):', {said('Primary cause', 'first_cause')}, {said('Secondary cause', 'second_cause')}, {after('p.lines')}, {after('entry_part')}, {after('finding_part')},
      CASE WHEN hurt IS NULL AND damage IS NULL THEN '' ELSE concat({br}, coalesce(hurt, ''), CASE WHEN hurt IS NOT NULL AND damage IS NOT NULL THEN '. ' ELSE '' END, CASE WHEN damage IS NULL THEN '' ELSE concat('Aircraft damage: ', damage) END, '.') END) AS block
    FROM whole w FULL OUTER JOIN coded c ON w.ev_id = c.ev_id LEFT JOIN place_lines p ON p.ev_id = coalesce(w.ev_id, c.ev_id)
    WHERE first_cause IS NOT NULL OR entry_part IS NOT NULL OR finding_part IS NOT NULL"""


@operator
def redact_spans(d):
    """Names out of quoted text, longest first; one-word spans stay."""
    return f"SELECT event_id, {d.replace_all(d.replace_all('t', r'John Paul Smith|Mary Ann Jones', '[name]'), r'John Smith|Mary Jones', '[name]')} AS redacted FROM (SELECT event_id, concat(event_type, CASE event_id % 4 WHEN 0 THEN ' by John Smith' WHEN 1 THEN ' by John Paul Smith and Mary Jones' WHEN 2 THEN ' by Mary' ELSE '' END) AS t FROM events) x"


@operator
def fenced_json(d):
    """The outermost object of a fenced reply."""
    return f"SELECT event_id, {d.json_field(d.extract('reply', '([{].*[}])'), 'k')} AS k FROM (SELECT event_id, concat('```json ', props, ' ``` done') AS reply FROM events) t"


@operator
def format_detection(d):
    return "SELECT format, count(*) AS n FROM (SELECT CASE WHEN cause_role IS NOT NULL AND idx >= 0 THEN 'v4' WHEN k IS NOT NULL THEN 'v3' ELSE 'unknown' END AS format FROM nodes) t GROUP BY format"


@operator
def html_title(d):
    """Page titles, for the label map of a scrape."""
    return f"SELECT page_id, {d.extract('html', '<title>([^<]*)</title>')} AS title FROM pages"


@operator
def resume_anti_join(d):
    """Work that is not done yet, by (source, record)."""
    return "SELECT c.record_id, c.source FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x ON x.doc_id = l.doc_id WHERE l.doc_id = c.record_id AND x.source = c.source)"


@operator
def judged_semi_join(d):
    return "SELECT c.record_id, c.wc FROM corpus c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.record_id AND l.quality = 1)"


@operator
def task_selection(d):
    """First tasks per model: invalid before pending, fewer than three attempts."""
    return "SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END, c_custkey) AS BIGINT) AS rn FROM customer WHERE c_custkey % 4 < 3) t WHERE rn <= 4"


@operator
def task_status(d):
    return "SELECT c_mktsegment AS model, CASE c_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' WHEN 2 THEN 'invalid' ELSE 'failed' END AS status, count(*) AS n FROM customer GROUP BY 1, 2"


@operator
def task_priority(d):
    return "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_totalprice > 150000 THEN 0 ELSE 1 END, o_totalprice, o_orderkey) AS BIGINT) AS place FROM orders"


@fixture
def doc_shingles(d):
    """Distinct five-word shingles of lower-cased texts; shorter texts give one shingle."""
    w = d.words("lower(text)")
    shingle = d.transform(d.sequence("1", f"greatest(1, {d.size('w')} - 4)"), "i", d.join_array(d.slice("w", "i", "5")))
    return f"SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, {d.explode}({shingle}) AS shingle FROM (SELECT doc_id, {w} AS w FROM documents WHERE length(trim(text)) > 0) a) b"


@operator
def shingle_counts(d):
    return "SELECT doc_id, count(*) AS n FROM doc_shingles GROUP BY doc_id"


@fixture
def blocked(d):
    """Clusters of (date, tail); records with an empty key stay alone."""
    return f"SELECT record_id, source, wc, source_rank, CASE WHEN date = '' OR tail = '' THEN concat('solo-', CAST(record_id AS {d.S})) ELSE concat(date, '/', tail) END AS cluster FROM filtered WHERE reason = 'keep'"


@operator
def cross_source_clusters(d):
    return f"SELECT cluster, count(*) AS size, min(record_id) AS first_member FROM blocked GROUP BY cluster HAVING count(*) > 1"


@operator
def cluster_representative(d):
    """The longest record of a cluster, the better source first among equals."""
    return "SELECT cluster, record_id, wc FROM (SELECT b.*, row_number() OVER (PARTITION BY cluster ORDER BY wc DESC, source_rank, record_id) AS rn FROM blocked b) t WHERE rn = 1"


@operator
def dedupe_pipeline(d):
    """Records by source before and after the clusters collapse."""
    return """SELECT b.source, count(*) AS kept_pre, count(r.record_id) AS final, count(*) - count(r.record_id) AS duplicates_removed FROM blocked b LEFT JOIN (
      SELECT record_id FROM (SELECT b.*, row_number() OVER (PARTITION BY cluster ORDER BY wc DESC, source_rank, record_id) AS rn FROM blocked b) t WHERE rn = 1) r ON r.record_id = b.record_id GROUP BY b.source"""


@operator
def tail_fallback(d):
    """Structured tail, else the first mark in the text."""
    first = d.extract("t", r"\b(N\d{1,5}[A-Z]{0,2})\b")
    return f"SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN concat('N', CAST(c_custkey AS {d.S})) ELSE '' END, ''), nullif({first}, ''), '') AS tail FROM tail_texts"
