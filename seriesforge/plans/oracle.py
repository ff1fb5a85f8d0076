"""The registered queries in plain SQL, for comparison with another engine on the same tables.

Written from the rules of the data, not from the Spark plans: explicit CASE and joins per rule
where the engine uses generic matching.
"""

DIMENSIONS = ["FREQ", "L_MEASURE", "L_POSITION", "L_INSTR", "L_DENOM", "L_CURR_TYPE",
              "L_PARENT_CTY", "L_REP_BANK_TYPE", "L_REP_CTY", "L_CP_SECTOR", "L_CP_COUNTRY"]
EXACT = "DECIMAL(38,6)"
KEYS = 'TIME_SERIES_CODE, "DATE", IBS_AGG'

_MICRO = f"""
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
    CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'GB' WHEN 3 THEN 'DE' ELSE 'JP' END AS reporting_country,
    'BANK_' || CAST(l_suppkey AS VARCHAR) AS reporting_institution,
    CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'L' END AS position_type,
    'A' AS instrument,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'USD' WHEN 'BUILDING' THEN 'EUR' WHEN 'FURNITURE' THEN 'JPY'
      WHEN 'HOUSEHOLD' THEN 'CHF' ELSE 'GBP' END AS currency,
    CASE WHEN l_returnflag = 'A' THEN 'D' ELSE 'F' END AS currency_type,
    '5J' AS parent_country, 'A' AS bank_type, '5J' AS counterpart_country,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'B' ELSE 'N' END AS sector_code,
    CASE WHEN l_discount >= 0.08 THEN -l_extendedprice ELSE l_extendedprice END AS transaction_amount,
    CASE l_orderkey % 20 WHEN 0 THEN 'C' WHEN 1 THEN 'N' ELSE 'F' END AS obs_conf,
    'LBSR' AS ibs_agg_scope,
    CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS date_scope,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

_KEY = """'Q.S.' || position_type || '.' || instrument || '.' || currency || '.' || currency_type || '.' ||
      parent_country || '.' || bank_type || '.' || reporting_country || '.' || sector_code || '.' || counterpart_country"""

_STRICTEST = "CASE WHEN bool_or(obs_conf = 'C') THEN 'C' WHEN bool_or(obs_conf = 'N') THEN 'N' ELSE 'F' END"


def _total(value):
    return f"CAST(sum(CAST({value} AS {EXACT})) AS DOUBLE)"


def _macro(source):
    return f"""
  SELECT {_KEY} AS TIME_SERIES_CODE, date_scope AS "DATE", ibs_agg_scope AS IBS_AGG,
    {_total('transaction_amount')} AS OBS_VALUE, {_STRICTEST} AS OBS_CONF, 'A' AS OBS_STATUS
  FROM {source} GROUP BY ALL HAVING sum(CAST(transaction_amount AS {EXACT})) <> 0"""


def _seg(i):
    return f"split_part(TIME_SERIES_CODE, '.', {i})"


def _reported(source, broken):
    number = f"(ascii({_seg(9)}) + 4 * CAST(left(\"DATE\", 4) AS INTEGER) + CAST(right(\"DATE\", 1) AS INTEGER))"
    is_total = f"{_seg(3)} = 'C' AND {_seg(5)} = 'TO1' AND {_seg(6)} = 'A' AND {_seg(10)} = 'A'"
    value = f"CASE WHEN {is_total} AND {number} % 7 = 0 THEN OBS_VALUE + 1000 ELSE OBS_VALUE END" if broken else "OBS_VALUE"
    return f"""
  SELECT TIME_SERIES_CODE, "DATE", IBS_AGG, {value} AS OBS_VALUE, OBS_STATUS, OBS_CONF FROM (
    SELECT 'Q.S.' || pos || '.A.' || denom || '.' || kind || '.5J.A.' || cty || '.' || sector || '.5J' AS TIME_SERIES_CODE,
      "DATE", IBS_AGG, {_total('OBS_VALUE')} AS OBS_VALUE, 'A' AS OBS_STATUS, {_STRICTEST} AS OBS_CONF
    FROM (
      SELECT pos, denom, kind, cty, unnest([sector, 'A']) AS sector, "DATE", IBS_AGG, OBS_VALUE, obs_conf FROM (
        SELECT {_seg(3)} AS pos, {_seg(5)} AS denom, {_seg(6)} AS kind, {_seg(9)} AS cty, {_seg(10)} AS sector,
          "DATE", IBS_AGG, OBS_VALUE, OBS_CONF AS obs_conf FROM {source}
        UNION ALL
        SELECT {_seg(3)}, 'TO1', 'A', {_seg(9)}, {_seg(10)}, "DATE", IBS_AGG, OBS_VALUE, OBS_CONF FROM {source}
        UNION ALL
        SELECT {_seg(3)}, 'TO1', 'F', {_seg(9)}, {_seg(10)}, "DATE", IBS_AGG, OBS_VALUE, OBS_CONF FROM {source} WHERE {_seg(6)} = 'F'
      ))
    GROUP BY pos, denom, kind, cty, sector, "DATE", IBS_AGG
    HAVING sum(CAST(OBS_VALUE AS {EXACT})) <> 0)"""


def _evaluated(source):
    denom, kind, sector = _seg(5), _seg(6), _seg(10)
    both = f"{denom} || ':' || {kind}"
    two = f"'Q.S.' || {_seg(3)} || '.' || {_seg(4)} || '.*.*.' || {_seg(7)} || '.' || {_seg(8)} || '.' || {_seg(9)} || '.' || {sector} || '.' || {_seg(11)}"
    one = f"'Q.S.' || {_seg(3)} || '.' || {_seg(4)} || '.' || {denom} || '.' || {kind} || '.' || {_seg(7)} || '.' || {_seg(8)} || '.' || {_seg(9)} || '.*.' || {_seg(11)}"
    checks = [
        ("LBS_CC01", two, f"{both} = 'TO1:A'",
         f"CAST({kind} = 'D' AS INTEGER) + CAST({both} = 'TO1:F' AS INTEGER) + CAST({both} = 'UN9:U' AS INTEGER)"),
        ("LBS_CC02", two, f"{both} = 'TO1:F'",
         f"CAST({both} IN ('USD:F', 'EUR:F', 'JPY:F', 'CHF:F', 'GBP:F', 'TO3:F') AS INTEGER)"),
        ("LBS_CC:04", one, f"{sector} = 'A'", f"CAST({sector} IN ('B', 'N') AS INTEGER)"),
    ]
    parts = [
        f"""SELECT '{name}' AS check_no, {context} AS context, "DATE", IBS_AGG, {_seg(9)} AS cty,
      CAST({total} AS INTEGER) AS t, {weight} AS w, CAST(OBS_VALUE AS {EXACT}) AS v FROM {source}"""
        for name, context, total, weight in checks
    ]
    return f"""
  SELECT check_no, context, "DATE", IBS_AGG, cty, CAST(sum(t) AS BIGINT) AS total_rows, CAST(sum(w) AS BIGINT) AS part_rows,
    CAST(sum(v * t) AS DOUBLE) AS total, CAST(sum(v * w) AS DOUBLE) AS parts,
    abs(sum(v * t) - sum(v * w)) >= 0.0001 AS failed
  FROM ({" UNION ALL ".join(parts)}) GROUP BY check_no, context, "DATE", IBS_AGG, cty
  HAVING sum(t) > 0 AND sum(w) > 0"""


def _validated(source, evaluated):
    return f"""
  SELECT r.*, CASE WHEN f.rules IS NULL THEN 'PASS' ELSE 'FAIL' END AS QUALITY_STATUS, f.rules AS FAILED_RULE_ID,
    CASE WHEN f.rules IS NULL THEN 'PUBLISHED' ELSE 'QUARANTINE' END AS BATCH_STATUS
  FROM {source} r LEFT JOIN (
    SELECT cty, "DATE", string_agg(DISTINCT check_no, ',' ORDER BY check_no) AS rules FROM {evaluated} WHERE failed GROUP BY cty, "DATE"
  ) f ON split_part(r.TIME_SERIES_CODE, '.', 9) = f.cty AND r."DATE" = f."DATE" """


def _hash(*columns):
    parts = []
    for c in columns:
        text = f"CAST(CAST({c} AS {EXACT}) AS VARCHAR)" if c == "OBS_VALUE" else c
        parts.append(f"coalesce({text}, chr(0) || 'NULL')")
    return "sha256(" + " || '||' || ".join(parts) + ")"


_MACRO_HASH = _hash("OBS_VALUE", "OBS_STATUS", "OBS_CONF", "QUALITY_STATUS", "FAILED_RULE_ID", "BATCH_STATUS")
T1, T2, OPEN = "'2026-05-15 08:00:00'", "'2026-08-14 08:00:00'", "'9999-12-31 00:00:00'"
_SAME_KEY = 'a.TIME_SERIES_CODE = b.TIME_SERIES_CODE AND a."DATE" = b."DATE" AND a.IBS_AGG = b.IBS_AGG'

def _changes(base, rev):
    return f"""
  SELECT CASE WHEN closed THEN reason ELSE 'kept' END AS change, h.* EXCLUDE (closed, reason, VALID_TO, IS_CURRENT),
    CASE WHEN closed THEN {T2} ELSE VALID_TO END AS VALID_TO, NOT closed AS IS_CURRENT
  FROM (
    SELECT a.*, {T1} AS VALID_FROM, {OPEN} AS VALID_TO, true AS IS_CURRENT,
      coalesce(a.version_hash <> b.version_hash, b.TIME_SERIES_CODE IS NULL AND p.cty IS NOT NULL) AS closed,
      CASE WHEN b.TIME_SERIES_CODE IS NULL THEN 'missing' ELSE 'expired' END AS reason
    FROM {base} a
    LEFT JOIN (SELECT * FROM {rev} WHERE BATCH_STATUS = 'PUBLISHED') b ON {_SAME_KEY}
    LEFT JOIN (SELECT DISTINCT {_seg(9)} AS cty, "DATE" AS d, IBS_AGG AS agg FROM {rev} WHERE BATCH_STATUS = 'PUBLISHED') p
      ON split_part(a.TIME_SERIES_CODE, '.', 9) = p.cty AND a."DATE" = p.d AND a.IBS_AGG = p.agg
  ) h
  UNION ALL BY NAME
  SELECT 'inserted' AS change, a.*, {T2} AS VALID_FROM, {OPEN} AS VALID_TO, true AS IS_CURRENT
  FROM {rev} a LEFT JOIN {base} b ON {_SAME_KEY}
  WHERE a.BATCH_STATUS = 'PUBLISHED' AND (b.TIME_SERIES_CODE IS NULL OR a.version_hash <> b.version_hash)
  UNION ALL BY NAME
  SELECT 'audit' AS change, a.*, {T2} AS VALID_FROM, {T2} AS VALID_TO, false AS IS_CURRENT
  FROM {rev} a LEFT JOIN {base} b ON {_SAME_KEY} AND a.version_hash = b.version_hash
  WHERE a.BATCH_STATUS <> 'PUBLISHED' AND b.TIME_SERIES_CODE IS NULL"""


def _bank_feed(source):
    return f"""
  SELECT {_KEY} AS TIME_SERIES_CODE, reporting_institution AS BANK_CODE, date_scope AS "DATE", ibs_agg_scope AS IBS_AGG,
    {_total('transaction_amount')} AS OBS_VALUE FROM {source} GROUP BY ALL"""


_BANK_KEY = _SAME_KEY + " AND a.BANK_CODE = b.BANK_CODE"


def _bank_history(gated, late="bank_late"):
    """Old rows closed or kept, new rows opened, rejected rows logged."""
    columns = 'TIME_SERIES_CODE, BANK_CODE, "DATE", IBS_AGG, OBS_VALUE, BATCH_STATUS, version_hash'
    names = "a." + columns.replace(", ", ", a.")
    payload = ("OBS_VALUE", "BATCH_STATUS") if gated else ("OBS_VALUE",)
    status = "CASE WHEN " + _seg(9) + " = 'GB' THEN 'QUARANTINE' ELSE 'PUBLISHED' END" if gated else "'PUBLISHED'"
    missing = "false" if gated else "p.cty IS NOT NULL"
    old = f"SELECT *, {_hash(*payload)} AS version_hash FROM (SELECT *, 'PUBLISHED' AS BATCH_STATUS FROM bank)"
    new = f"SELECT *, {_hash(*payload)} AS version_hash FROM (SELECT *, {status} AS BATCH_STATUS FROM {late})"
    return f"""
  SELECT {columns}, {T1} AS effective_start_date, CASE WHEN closed THEN {T2} ELSE {OPEN} END AS effective_end_date, NOT closed AS is_current
  FROM (SELECT {names}, coalesce(a.version_hash <> b.version_hash, {missing}) AS closed
    FROM ({old}) a LEFT JOIN (SELECT * FROM ({new}) WHERE BATCH_STATUS = 'PUBLISHED') b ON {_BANK_KEY}
    LEFT JOIN (SELECT DISTINCT {_seg(9)} AS cty, "DATE" AS d, IBS_AGG AS agg FROM {late}) p
      ON split_part(a.TIME_SERIES_CODE, '.', 9) = p.cty AND a."DATE" = p.d AND a.IBS_AGG = p.agg)
  UNION ALL
  SELECT {names}, {T2}, CASE WHEN a.BATCH_STATUS = 'PUBLISHED' THEN {OPEN} ELSE {T2} END, a.BATCH_STATUS = 'PUBLISHED'
  FROM ({new}) a LEFT JOIN ({old}) b ON {_BANK_KEY} AND a.version_hash = b.version_hash
  WHERE b.TIME_SERIES_CODE IS NULL"""


_CTES = {
    "micro": (_MICRO, ()),
    "micro_late": (_MICRO + " WHERE l_linenumber <> 7", ()),
    "macro": (_macro("micro"), ("micro",)),
    "macro_late": (_macro("micro_late"), ("micro_late",)),
    "reported": (_reported("macro", True), ("macro",)),
    "clean": (_reported("macro", False), ("macro",)),
    "revised": (_reported("macro_late", True), ("macro_late",)),
    "evaluated": (_evaluated("reported"), ("reported",)),
    "evaluated_revised": (_evaluated("revised"), ("revised",)),
    "validated": (_validated("reported", "evaluated"), ("reported", "evaluated")),
    "base": (
        f"SELECT *, {_MACRO_HASH} AS version_hash FROM (SELECT *, 'PASS' AS QUALITY_STATUS, "
        "CAST(NULL AS VARCHAR) AS FAILED_RULE_ID, 'PUBLISHED' AS BATCH_STATUS FROM clean)",
        ("clean",),
    ),
    "rev": (
        f"SELECT *, {_MACRO_HASH} AS version_hash FROM ({_validated('revised', 'evaluated_revised')})",
        ("revised", "evaluated_revised"),
    ),
    "changes": (_changes("base", "rev"), ("base", "rev")),
    "hist": (
        "SELECT * EXCLUDE (change), "
        + ", ".join(f"{_seg(i)} AS {d}" for i, d in enumerate(DIMENSIONS, 1))
        + " FROM changes",
        ("changes",),
    ),
    "bank": (_bank_feed("micro"), ("micro",)),
    "bank_late": (_bank_feed("micro_late"), ("micro_late",)),
    "bank_history": (_bank_history(False), ("bank", "bank_late")),
    "bank_late_ca": (f"SELECT * FROM bank_late WHERE {_seg(9)} = 'CA'", ("bank_late",)),
    "bank_history_ca": (_bank_history(False, "bank_late_ca"), ("bank", "bank_late_ca")),
    "sent": ("SELECT * FROM micro UNION ALL SELECT * REPLACE ('A' AS sector_code) FROM micro", ("micro",)),
    "sent_late": (
        "SELECT * FROM micro_late UNION ALL SELECT * REPLACE ('A' AS sector_code) FROM micro_late WHERE reporting_country <> 'GB' "
        "UNION ALL SELECT * REPLACE ('A' AS sector_code) FROM micro WHERE reporting_country = 'GB'",
        ("micro", "micro_late"),
    ),
    **{
        name: step
        for late in ("", "_late")
        for name, step in (
            (f"sums{late}", (_macro(f"sent{late}"), (f"sent{late}",))),
            (f"checks{late}", (_evaluated(f"sums{late}"), (f"sums{late}",))),
            (f"stored{late}", (
                f"SELECT *, {_MACRO_HASH} AS version_hash FROM ({_validated(f'sums{late}', f'checks{late}')})",
                (f"sums{late}", f"checks{late}"),
            )),
        )
    },
    "stored_history": (_changes("stored", "stored_late"), ("stored", "stored_late")),
    "bank_gated": (_bank_history(True), ("bank", "bank_late")),
    "dominance": (
        f"""
  SELECT *, 'A' AS OBS_STATUS, CASE WHEN MAX_BANK_SHARE >= 0.60 THEN 'N' ELSE 'F' END AS OBS_CONF FROM (
    SELECT {KEYS}, CAST(sum(v) AS DOUBLE) AS OBS_VALUE,
      coalesce(CAST(max(abs(v)) AS DOUBLE) / nullif(CAST(sum(abs(v)) AS DOUBLE), 0), 0.0) AS MAX_BANK_SHARE
    FROM (SELECT {_KEY} AS TIME_SERIES_CODE, date_scope AS "DATE", ibs_agg_scope AS IBS_AGG, reporting_institution,
        sum(CAST(transaction_amount AS {EXACT})) AS v FROM micro GROUP BY ALL)
    GROUP BY {KEYS} HAVING sum(v) <> 0)""",
        ("micro",),
    ),
    "seen": (
        """
  SELECT * EXCLUDE (OBS_VALUE), CASE WHEN OBS_CONF IN ('C', 'N') THEN NULL ELSE OBS_VALUE END AS OBS_VALUE
  FROM hist WHERE BATCH_STATUS = 'PUBLISHED' AND IS_CURRENT""",
        ("hist",),
    ),
    "members": (
        """
  SELECT CAST(c_custkey AS VARCHAR) AS principal, list_filter([
      CASE c_custkey % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'researcher' WHEN 2 THEN 'public' WHEN 3 THEN 'submitter-' || cc END,
      CASE WHEN c_custkey % 4 = 1 THEN 'submitter-' || cc END], lambda g: g IS NOT NULL) AS groups,
    cc
  FROM (SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 'ca' WHEN 1 THEN 'us' WHEN 2 THEN 'gb' WHEN 3 THEN 'de' ELSE 'jp' END AS cc
    FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
        (),
    ),
}


def _with(body, *names):
    """The statement with the common tables it needs, each after those it reads."""
    ordered = []

    def add(name):
        for needed in _CTES[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in ordered)
    return f"WITH {tables}\n{body}" if tables else body


def _plain(value):
    return f"regexp_replace(CAST(CAST({value} AS {EXACT}) AS VARCHAR), '\\.?0+$', '')"


_GOVERNED = f"{KEYS}, OBS_VALUE, OBS_CONF, BATCH_STATUS, IS_CURRENT, version_hash"
_NO_VALUE = f"{KEYS}, OBS_CONF, BATCH_STATUS, IS_CURRENT, version_hash"
_VERSIONS = f"{KEYS}, OBS_VALUE, OBS_CONF, FAILED_RULE_ID, BATCH_STATUS, version_hash, VALID_FROM, VALID_TO, IS_CURRENT"
_RESULT = f"{KEYS}, OBS_VALUE, OBS_STATUS, OBS_CONF, QUALITY_STATUS, BATCH_STATUS, IS_CURRENT"
_PAGE = f"{_RESULT}, {', '.join(DIMENSIONS)}"
_ORDER = 'ORDER BY TIME_SERIES_CODE, "DATE", VALID_FROM, version_hash'
_MASK = "CASE WHEN OBS_CONF IN ('C', 'N') THEN NULL ELSE OBS_VALUE END AS OBS_VALUE"
_MASK_CA = "CASE WHEN OBS_CONF IN ('C', 'N') AND L_REP_CTY <> 'CA' THEN NULL ELSE OBS_VALUE END AS OBS_VALUE"
_PUBLISHED = "BATCH_STATUS = 'PUBLISHED'"
_FREE = "BATCH_STATUS = 'PUBLISHED' AND OBS_CONF = 'F'"
_SPLIT = ", ".join(f"{_seg(i)} AS {d}" for i, d in enumerate(DIMENSIONS, 1))
_TYPE = "CASE WHEN cty IN ('GB', 'US') THEN 'Revision' WHEN cty = 'JP' THEN 'Break in Series' ELSE 'First Submission' END"
_ACTION = "CASE WHEN cty IN ('GB', 'JP', 'US') THEN 'Replace' ELSE 'Information' END"
_SENDER = "CASE cty WHEN 'CA' THEN 'BOC' WHEN 'US' THEN 'FRB' WHEN 'GB' THEN 'BOE' ELSE 'ZZZ' END"
_SENDER_NAME = ("CASE cty WHEN 'CA' THEN 'Bank of Canada' WHEN 'US' THEN 'Federal Reserve System' "
                "WHEN 'GB' THEN 'Bank of England' END")


def _governed(select, where):
    return _with(f"SELECT {select} FROM hist WHERE {where}", "hist")


def _stored(value, where):
    rows = f"(SELECT *, {_seg(5)} AS L_DENOM, {_seg(9)} AS L_REP_CTY FROM stored_history)"
    return _with(f"SELECT {_GOVERNED.replace('OBS_VALUE', value)} FROM {rows} WHERE {where}", "stored_history")


def _xml(select):
    observation = f"""'      <Obs TIME_PERIOD="' || "DATE" || '"' || CASE WHEN OBS_VALUE IS NULL THEN '' ELSE ' OBS_VALUE="' || {_plain('OBS_VALUE')} || '"' END
      || ' OBS_STATUS="' || OBS_STATUS || '" OBS_CONF="' || OBS_CONF || '"/>'"""
    opening = "'    <Series' || " + " || ".join(f"' {d}=\"' || {d} || '\"'" for d in DIMENSIONS) + " || '>'"
    lines = f"""
    SELECT TIME_SERIES_CODE, 1 AS part, "DATE" AS TIME_PERIOD, {observation} AS line FROM seen
    UNION ALL SELECT DISTINCT TIME_SERIES_CODE, 0, '', {opening} FROM seen
    UNION ALL SELECT DISTINCT TIME_SERIES_CODE, 2, '', '    </Series>' FROM seen"""
    return _with(select.format(lines=f"({lines})"), "seen")


_RULE_CELLS = r"""
WITH wide AS (
  SELECT CASE WHEN p_brand <> 'Brand#11' THEN ' PC:' || CAST(p_partkey AS VARCHAR) END AS check_no, p_name AS description,
    CASE p_partkey % 5 WHEN 0 THEN '5 and 6' WHEN 1 THEN '10' WHEN 2 THEN '5, 6 and 12' WHEN 3 THEN '12' ELSE '9.0' END AS positions,
    CASE WHEN p_size = 17 THEN '…' WHEN p_partkey % 5 IN (0, 2) THEN 'TO1:A' ELSE 'U' || CAST(p_size % 10 AS VARCHAR) END AS c0,
    CASE WHEN p_partkey % 5 IN (0, 2) THEN '[ISO:D]' ELSE left(p_type, 1) END AS c1,
    CASE WHEN p_partkey % 5 IN (0, 2) THEN 'UN9:U' || CAST(p_size % 10 AS VARCHAR) ELSE ' .. ' END AS c2,
    CASE WHEN p_size % 3 = 0 THEN 'TO1' WHEN p_partkey % 5 IN (0, 2) THEN ' usd : F ' ELSE '[N]' END AS c3
  FROM part),
dims AS (
  SELECT *, list_transform(list_filter(list_transform(regexp_extract_all(positions, '\d+'), lambda x: CAST(x AS INTEGER)),
    lambda x: x BETWEEN 1 AND 11), lambda x: ['FREQ','L_MEASURE','L_POSITION','L_INSTR','L_DENOM','L_CURR_TYPE','L_PARENT_CTY',
    'L_REP_BANK_TYPE','L_REP_CTY','L_CP_SECTOR','L_CP_COUNTRY'][x]) AS d
  FROM wide WHERE check_no IS NOT NULL),
cells AS (
  SELECT check_no, description, d, 0 AS col, c0 AS cell FROM dims UNION ALL SELECT check_no, description, d, 1, c1 FROM dims
  UNION ALL SELECT check_no, description, d, 2, c2 FROM dims UNION ALL SELECT check_no, description, d, 3, c3 FROM dims),
texts AS (
  SELECT *, regexp_replace(regexp_replace(cell, '^\s*[\[\]]*\s*', ''), '\s*[\[\]]*\s*$', '') AS t FROM cells),
parsed AS (
  SELECT trim(check_no) AS check_no, trim(description) AS description, col, d,
    list_transform(string_split(t, ':'), lambda x: regexp_replace(trim(x), '^([A-Za-z])\d+$', '\1')) AS codes
  FROM texts WHERE NOT regexp_matches(t, '^[.…\s]*$') AND len(string_split(t, ':')) = len(d) AND len(d) > 0),
shown AS (
  SELECT check_no, description, col, list_aggregate(list_transform(list_zip(d, codes), lambda x: x[1] || '=' || x[2]), 'string_agg', ',') AS codes
  FROM parsed)
SELECT check_no, description, CAST(CASE WHEN col = 0 THEN 0 ELSE n END AS INTEGER) AS component_no, codes FROM (
  SELECT *, row_number() OVER (PARTITION BY check_no, col > 0 ORDER BY col) AS n,
    bool_or(col = 0) OVER (PARTITION BY check_no) AS has_total, bool_or(col > 0) OVER (PARTITION BY check_no) AS has_part
  FROM shown) WHERE has_total AND has_part"""

def _codes(source):
    columns = {**{d: d for d in DIMENSIONS}, "TIME_PERIOD": '"DATE"', "OBS_STATUS": "OBS_STATUS", "OBS_CONF": "OBS_CONF"}
    each = " UNION ".join(f"SELECT '{name}' AS component, {column} AS id FROM {source}" for name, column in columns.items())
    return f"""
  codes AS (
    SELECT component, id, CAST(dense_rank() OVER (PARTITION BY component ORDER BY id) - 1 AS INTEGER) AS position FROM ({each}))"""


def _json_series(source="seen", framework=""):
    """Series by position; `framework` names a column (with a comma) that keeps them apart."""
    names = DIMENSIONS + ["TIME_PERIOD", "OBS_STATUS", "OBS_CONF"]
    columns = {d: f"s.{d}" for d in DIMENSIONS}
    columns.update(TIME_PERIOD='s."DATE"', OBS_STATUS="s.OBS_STATUS", OBS_CONF="s.OBS_CONF")
    joins = " ".join(f"JOIN codes c{i} ON c{i}.component = '{n}' AND c{i}.id = {columns[n]}" for i, n in enumerate(names))
    key = " || ':' || ".join(f"CAST(c{i}.position AS VARCHAR)" for i in range(11))
    cell = (f"""'"' || CAST(c11.position AS VARCHAR) || '":[' || coalesce({_plain('s.OBS_VALUE')}, 'null') || ',' || """
            "CAST(c12.position AS VARCHAR) || ',' || CAST(c13.position AS VARCHAR) || ']'")
    return f"""
SELECT {framework} series_key, '{{' || string_agg(cell, ',' ORDER BY place) || '}}' AS observations FROM (
  SELECT {framework} {key} AS series_key, c11.position AS place, {cell} AS cell FROM {source} s {joins}) GROUP BY {framework} series_key"""


def _json_document():
    """Entry lines of all rows, rejected and closed ones too, with British series under a second framework."""
    return _with("", "hist").rstrip() + f""",
  sent AS (SELECT * FROM hist UNION ALL SELECT * REPLACE ('LBSN' AS IBS_AGG) FROM hist WHERE L_REP_CTY = 'GB'),
  best AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY {KEYS}
    ORDER BY IS_CURRENT DESC, BATCH_STATUS = 'PUBLISHED' DESC, VALID_FROM DESC, version_hash DESC) = 1),""" + _codes("sent") + f""",
  entries AS ({_json_series("best", "IBS_AGG,")})
SELECT line, count(*) AS n FROM (
  SELECT CASE WHEN series_key = min(series_key) OVER (PARTITION BY IBS_AGG) THEN '' ELSE ',' END ||
    '"' || series_key || '":{{"attributes":[],"observations":' || observations || '}}' AS line FROM entries) GROUP BY line"""


def oracle_sql() -> dict:
    late_short = f"regexp_replace(TIME_SERIES_CODE, '\\.[^.]*$', '')"
    quarter = 'right("DATE", 1)'
    codes = "reporting_country position_type instrument currency currency_type parent_country bank_type counterpart_country sector_code obs_conf ibs_agg_scope"
    codes = ", ".join(codes.split())
    dominance_cty = _with(f"SELECT {{}} FROM (SELECT *, {_seg(9)} AS cty FROM dominance) {{}}", "dominance")
    own_country = f"L_REP_CTY = 'CA'"
    visible = """
  SELECT m.principal, h.*, list_contains(m.groups, 'admin') OR list_contains(m.groups, 'submitter-' || lower(h.cty)) AS own
  FROM members m JOIN (SELECT L_REP_CTY AS cty, BATCH_STATUS, OBS_CONF, IS_CURRENT, count(*) AS n FROM hist GROUP BY ALL) h
    ON list_contains(m.groups, 'admin')
    OR (list_contains(m.groups, 'researcher') AND h.BATCH_STATUS = 'PUBLISHED')
    OR (len(list_filter(m.groups, lambda g: g = 'public' OR g LIKE 'submitter-%')) > 0 AND h.BATCH_STATUS = 'PUBLISHED' AND h.OBS_CONF = 'F')
    OR list_contains(m.groups, 'submitter-' || lower(h.cty))"""
    return {
        "q_micro_ledger": _with("SELECT * FROM micro", "micro"),
        "q_batch_stamp": _with(
            f"SELECT * REPLACE ('2026-Q1' AS date_scope, {T1} AS transaction_timestamp) FROM micro", "micro"),
        "q_ledger_append": _with(
            f"SELECT date_scope, reporting_country, count(*) AS row_count, count(*) FILTER (position_type = 'L') AS with_channel, "
            f"{_total('transaction_amount')} AS amount FROM micro GROUP BY date_scope, reporting_country", "micro"),
        "q_normalise": _with(f"SELECT {codes}, count(*) AS row_count FROM micro GROUP BY {codes}", "micro"),
        "q_codelist_offenders": _with(
            "SELECT DISTINCT CASE currency WHEN 'CHF' THEN 'X' END AS sector_code FROM micro WHERE currency IN ('CHF', 'JPY')", "micro"),
        "q_macro_rollup": _with("SELECT * FROM macro", "macro"),
        "q_conf_elevation": _with(
            f'SELECT {_KEY} AS TIME_SERIES_CODE, date_scope AS "DATE", ibs_agg_scope AS IBS_AGG, {_STRICTEST} AS OBS_CONF FROM micro GROUP BY ALL', "micro"),
        "q_zero_drop": _with(
            f"SELECT {KEYS}, OBS_VALUE, OBS_CONF FROM macro WHERE {_seg(10)} <> 'N'" + "".join(
                f"""
UNION ALL SELECT {_KEY}, date_scope, ibs_agg_scope, {value}, {_STRICTEST}
FROM (SELECT * REPLACE ('{instrument}' AS instrument) FROM micro WHERE sector_code = 'B') GROUP BY ALL {having}"""
                for instrument, value, having in (
                    ("X1", "CAST(CAST(4 * count(*) AS VARCHAR) || 'e-7' AS DOUBLE)", ""),
                    ("X2", "CAST(CAST(count(*) AS VARCHAR) || 'e-300' AS DOUBLE)", ""),
                    ("X3", _total("transaction_amount"), f"HAVING sum(CAST(transaction_amount AS {EXACT})) <> 0"),
                )), "macro", "micro"),
        "q_micro_feed_csv": _with(
            f'SELECT {_KEY} AS TIME_SERIES_CODE, reporting_institution AS BANK_CODE, date_scope AS "DATE", '
            "ibs_agg_scope AS IBS_AGG, transaction_amount AS OBS_VALUE FROM micro", "micro"),
        "q_dominance": _with(f"SELECT {KEYS}, OBS_VALUE, MAX_BANK_SHARE, OBS_CONF, OBS_STATUS FROM dominance", "dominance"),
        "q_explode_key": _with(f'SELECT {_SPLIT}, "DATE" AS TIME_PERIOD, OBS_VALUE, OBS_STATUS, OBS_CONF FROM macro', "macro"),
        "q_key_rejects": _with(
            f"SELECT CASE {quarter} WHEN '1' THEN {late_short} WHEN '2' THEN TIME_SERIES_CODE || '.X' END AS TIME_SERIES_CODE, "
            f"CAST(CASE {quarter} WHEN '1' THEN 10 WHEN '2' THEN 12 ELSE 0 END AS INTEGER) AS segment_count FROM macro WHERE {quarter} <> '4'", "macro"),
        "q_rules_parse": _RULE_CELLS,
        "q_rule_eval": _with("SELECT * EXCLUDE (cty) FROM evaluated", "evaluated"),
        "q_validate": _with("SELECT * FROM validated", "validated"),
        "q_batch_summary": _with(
            f'SELECT {_seg(9)} AS REP_CTY, "DATE", BATCH_STATUS, FAILED_RULE_ID, count(*) AS row_count FROM validated GROUP BY ALL', "validated"),
        "q_batch_decision": _with(f'SELECT DISTINCT {_seg(9)} AS SUBMITTING_COUNTRY, "DATE", BATCH_STATUS FROM validated', "validated"),
        "q_version_hash": _with(
            f"SELECT {KEYS}, {_hash('OBS_VALUE', 'OBS_STATUS', 'OBS_CONF', 'CAST(NULL AS VARCHAR)')} AS version_hash FROM macro", "macro"),
        "q_scd2_init": _with(
            f"SELECT {KEYS}, OBS_VALUE, OBS_CONF, FAILED_RULE_ID, BATCH_STATUS, version_hash, {T2} AS VALID_FROM, "
            f"CASE WHEN {_PUBLISHED} THEN {OPEN} ELSE {T2} END AS VALID_TO, {_PUBLISHED} AS IS_CURRENT FROM rev", "rev"),
        "q_schema_patch": _with(f"SELECT {KEYS}, version_hash FROM base", "base"),
        **{
            f"q_scd2_{name}": _with(f"SELECT {_VERSIONS} FROM changes WHERE change = '{label}'", "changes")
            for name, label in (("expire", "expired"), ("insert", "inserted"), ("quarantine", "audit"), ("delete", "missing"))
        },
        "q_scd2_full": _with(f"SELECT {_VERSIONS} FROM changes", "changes"),
        "q_scd2_change_counts": _with("SELECT change, count(*) AS row_count FROM changes GROUP BY change", "changes"),
        "q_scd2_replay": _with("SELECT 'kept' AS change, count(*) AS row_count FROM changes", "changes"),
        "q_scd2_micro": _with("SELECT * EXCLUDE (BATCH_STATUS) FROM bank_history", "bank_history"),
        "q_scd2_micro_one_country": _with("SELECT * EXCLUDE (BATCH_STATUS) FROM bank_history_ca", "bank_history_ca"),
        "q_submission_validate": _with(
            f'SELECT {_seg(9)} AS SUBMITTING_COUNTRY, "DATE", BATCH_STATUS, FAILED_RULE_ID, count(*) AS row_count FROM validated GROUP BY ALL', "validated"),
        "q_store_two_cycles": _with(f"SELECT {_VERSIONS} FROM stored_history", "stored_history"),
        "q_store_read_periods": _with(
            f"SELECT {_VERSIONS} FROM stored_history WHERE \"DATE\" IN ('1994-Q2', '1996-Q1', '1996-Q4')", "stored_history"),
        "q_store_micro_two_countries": _with(
            f"SELECT * EXCLUDE (BATCH_STATUS), CASE WHEN effective_start_date = {T2} THEN 'web' END AS channel FROM bank_history_ca WHERE {_seg(9)} IN ('CA', 'GB')",
            "bank_history_ca"),
        "q_store_compacted": _with(f"SELECT {_VERSIONS} FROM stored_history", "stored_history"),
        "q_store_rls_researcher": _stored(_MASK, _PUBLISHED),
        "q_store_rls_public": _stored(_MASK, _FREE),
        "q_store_rls_submitter_ca": _stored(_MASK_CA, f"{own_country} OR ({_FREE})"),
        "q_store_search": _stored(
            "OBS_VALUE", "L_REP_CTY = 'GB' AND L_DENOM IN ('EUR', 'USD') AND \"DATE\" >= '1994' AND (IS_CURRENT OR BATCH_STATUS = 'QUARANTINE')"),
        "q_scd2_micro_gated":_with("SELECT * FROM bank_gated", "bank_gated"),
        "q_two_cycle_state": _with(
            'SELECT L_REP_CTY, BATCH_STATUS, IS_CURRENT, count(*) AS row_count, count(DISTINCT "DATE") AS periods FROM hist GROUP BY ALL', "hist"),
        "q_history_state": _with("SELECT BATCH_STATUS, IS_CURRENT, count(*) AS row_count FROM hist GROUP BY ALL", "hist"),
        "q_published_view": _with(f"SELECT {KEYS}, OBS_VALUE, OBS_STATUS, OBS_CONF FROM hist WHERE {_PUBLISHED} AND IS_CURRENT", "hist"),
        "q_history_union": _with(
            f"SELECT {_RESULT} FROM hist UNION ALL SELECT {KEYS}, OBS_VALUE, NULL, NULL, NULL, BATCH_STATUS, is_current FROM bank_gated",
            "hist", "bank_gated"),
        "q_rls_admin": _governed(_GOVERNED, "true"),
        "q_rls_researcher": _governed(_NO_VALUE, _PUBLISHED),
        "q_rls_public": _governed(_GOVERNED, _FREE),
        "q_rls_submitter_ca": _governed(_GOVERNED, f"{own_country} OR ({_FREE})"),
        "q_rls_multi": _governed(_NO_VALUE, f"{own_country} OR {_PUBLISHED}"),
        "q_mask_researcher": _governed(_GOVERNED.replace("OBS_VALUE", _MASK), _PUBLISHED),
        "q_mask_multi": _governed(_GOVERNED.replace("OBS_VALUE", _MASK_CA), f"{own_country} OR {_PUBLISHED}"),
        "q_rls_micro": _with(
            "SELECT transaction_id, reporting_country, reporting_institution, transaction_amount FROM micro WHERE reporting_country = 'GB'", "micro"),
        "q_rls_counts": _with(
            f"""SELECT m.principal, CAST(coalesce(sum(n), 0) AS BIGINT) AS visible_rows,
  CAST(coalesce(sum(n) FILTER (IS_CURRENT), 0) AS BIGINT) AS current_rows,
  CAST(coalesce(sum(n) FILTER (OBS_CONF IN ('C', 'N') AND NOT own), 0) AS BIGINT) AS masked_rows
FROM members m LEFT JOIN ({visible}) v ON m.principal = v.principal GROUP BY m.principal""", "hist", "members"),
        "q_persona": _with(
            """SELECT principal, CASE WHEN list_contains(groups, 'admin') THEN 'admin'
    WHEN list_contains(groups, 'submitter-' || cc) THEN 'submitter-' || cc WHEN list_contains(groups, 'researcher') THEN 'researcher'
    WHEN list_contains(groups, 'public') THEN 'public' ELSE 'none' END AS persona,
  list_contains(groups, 'admin') OR list_contains(groups, 'submitter-' || cc) AS may_see_quarantine FROM members""", "members"),
        "q_search": _governed(
            _PAGE.replace("OBS_VALUE", _MASK),
            f"{_PUBLISHED} AND IS_CURRENT AND L_REP_CTY IN ('CA', 'US') AND L_DENOM IN ('TO1', 'USD') {_ORDER} LIMIT 500"),
        "q_search_period": _governed(
            _PAGE, f"{_FREE} AND IS_CURRENT AND L_POSITION = 'C' AND \"DATE\" >= '1995-Q2' AND \"DATE\" <= '1997-Q3' {_ORDER} LIMIT 20000"),
        "q_search_quarantine": _governed(
            _PAGE, f"{own_country} AND (IS_CURRENT OR BATCH_STATUS = 'QUARANTINE') {_ORDER} LIMIT 20000"),
        "q_search_summary": _with(
            f"""SELECT count(*) AS row_count, count(*) FILTER (OBS_VALUE IS NULL) AS masked_observations,
  (SELECT count(*) FROM seen WHERE L_REP_CTY IN ('CA', 'US', 'GB')) > 500 AS truncated
FROM (SELECT * FROM seen WHERE L_REP_CTY IN ('CA', 'US', 'GB') {_ORDER} LIMIT 500)""", "seen"),
        "q_facets": _with(
            " UNION ".join(
                f"SELECT '{d}' AS dimension, {d} AS code FROM hist WHERE IS_CURRENT AND (L_REP_CTY = 'US' OR ({_FREE}))"
                for d in ("L_PARENT_CTY", "L_REP_CTY", "L_CP_SECTOR", "L_CP_COUNTRY", "L_DENOM", "L_POSITION", "L_INSTR")
            ), "hist"),
        "q_lifecycle_status": _with(
            f"""SELECT {_SPLIT}, "DATE" AS TIME_PERIOD, CASE WHEN cty = 'JP' THEN 'B' ELSE OBS_STATUS END AS OBS_STATUS,
  {_TYPE} AS SUBMISSION_TYPE, {_ACTION} AS DATASET_ACTION, {_SENDER} AS SENDER_ID,
  cty || '_LBSR_' || replace("DATE", '-', '') AS DATASET_ID FROM (SELECT *, {_seg(9)} AS cty FROM macro)""", "macro"),
        "q_submission_summary": dominance_cty.format(
            f"cty AS country, {_SENDER} AS SENDER_ID, {_TYPE} AS SUBMISSION_TYPE, {_ACTION} AS DATASET_ACTION, "
            "count(*) AS series_count, count(*) FILTER (OBS_CONF = 'N') AS restricted_series", "GROUP BY cty"),
        "q_submission_write": dominance_cty.format(
            f"""DISTINCT cty || '_LBSR_' || replace("DATE", '-', '') AS dataset_id, {_ACTION} AS dataset_action, """
            f"{_SENDER} AS sender_id, {_SENDER_NAME} AS sender_name", ""),
        "q_submission_scan": dominance_cty.format(
            f"lower(cty) AS SUBMITTED_BY, {KEYS}, OBS_VALUE, CASE WHEN cty = 'JP' THEN 'B' ELSE OBS_STATUS END AS OBS_STATUS, OBS_CONF", ""),
        "q_series_group": _xml("SELECT * FROM {lines}"),
        "q_sdmx_ml": _xml("SELECT line, count(*) AS n FROM {lines} GROUP BY line"),
        "q_sdmx_ml_roundtrip": _xml(
            "SELECT CASE part WHEN 0 THEN 'Series' WHEN 1 THEN 'Obs' ELSE '/Series' END AS element, count(*) AS n FROM {lines} GROUP BY 1"),
        "q_sdmx_json_dict": _with("", "seen").rstrip() + "," + _codes("seen") + "\nSELECT * FROM codes",
        "q_sdmx_json_series": _with("", "seen").rstrip() + "," + _codes("seen") + _json_series(),
        "q_sdmx_json_document": _json_document(),
        "q_sdmx_csv": _with(
            f"""SELECT 'dataflow' AS STRUCTURE, 'BIS:WS_LBS_D_PUB(1.0)' AS STRUCTURE_ID, 'R' AS ACTION, {', '.join(DIMENSIONS)},
  "DATE" AS TIME_PERIOD, coalesce({_plain('OBS_VALUE')}, '') AS OBS_VALUE, OBS_STATUS, OBS_CONF FROM seen""", "seen"),
        "q_tidy_csv": _with(
            f"""SELECT TIME_SERIES_CODE, {', '.join(DIMENSIONS)}, "DATE" AS TIME_PERIOD, OBS_VALUE, OBS_STATUS, OBS_CONF,
  IBS_AGG, BATCH_STATUS, QUALITY_STATUS FROM seen""", "seen"),
    }
