"""The registered queries as SQL over the same tables, written from the definitions."""

from __future__ import annotations

import ipaddress

ORACLE: dict[str, str] = {}

# Fixed values, written apart from the code under test: addresses that are not public.
NOT_PUBLIC = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",)
BUT_PUBLIC = ("192.0.0.9", "192.0.0.10",)
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID = "^" + r"\.".join([OCTET] * 4) + "$"

NL = "chr(10)"
TAB = "chr(9)"


def _pick(values, index: str) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[1 + ({index})]"


def _ip(u: str, j: str) -> str:
    return f"concat(1 + ({u}) % 223, '.', ({u}) % 256, '.', {j}, '.', 1 + ({u}) % 250)"


def _number(x: str) -> str:
    return " + ".join(
        f"CAST(split_part({x}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
    )


def _private(x: str) -> str:
    nets = [ipaddress.ip_network(r) for r in NOT_PUBLIC]
    tests = " OR ".join(
        f"({_number(x)}) BETWEEN {int(n[0])} AND {int(n[-1])}" for n in nets
    )
    keep = ", ".join(f"'{a}'" for a in BUT_PUBLIC)
    return f"(({tests}) AND {x} NOT IN ({keep}))"


def _ips(x: str) -> str:
    found = rf"regexp_extract_all({x}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')"
    return f"list_filter({found}, lambda a: regexp_matches(a, '{VALID}'))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _has(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _case(*pairs: tuple[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def _display(x: str) -> str:
    low = f"lower({x})"
    return _case(
        (f"{x} IS NULL", "'Unspecified'"),
        (_has(low, "high", "yüksek"), "'High'"),
        (_has(low, "medium", "orta"), "'Medium'"),
        (_has(low, "low", "düşük"), "'Low'"),
        (_has(low, "critical"), "'Critical'"),
        default=_strip(x),
    )


def _bucket(x: str, high: str = "High") -> str:
    low = f"lower({x})"
    return _case(
        (_has(low, "high", "yüksek"), f"'{high}'"),
        (_has(low, "medium", "orta"), "'Medium'"),
        (_has(low, "low", "düşük"), "'Low'"),
        default="'Unspecified'",
    )


def _answer(x: str) -> str:
    low = f"lower({_strip(x)})"
    return _case(
        (f"{low} IN ('low', 'düşük')", "'Düşük'"),
        (f"{low} IN ('medium', 'orta')", "'Orta'"),
        (f"{low} IN ('high', 'yüksek')", "'Yüksek'"),
        (_has(low, "high", "yüksek"), "'Yüksek'"),
        (_has(low, "medium", "orta"), "'Orta'"),
        (_has(low, "low", "düşük"), "'Düşük'"),
        default="'Orta'",
    )


USER = (
    "coalesce(" + ", ".join(
        rf"nullif(regexp_extract(message, '(?i){p}', 1), '')"
        for p in (r"Account Name:\s*([^\s\n]+)", r"User Name:\s*([^\s\n]+)", r"Account Name\s+([^\s\n]+)", r"User\s+([^\s\n]+)")
    ) + ")"
)

# --- the given tables in the shapes of the operators ------------------------------

_NAME = "CASE event_id % 7 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN '-' ELSE concat('user', user_id % 40) END"
_IP = _ip("user_id", "event_id % 4")
_IMAGES = (r"C:\Windows\cmd.exe", r"C:\Windows\powershell.exe", r"C:\Apps\notepad.exe", r"C:\Apps\chrome.exe")
_COMMANDS = ("cmd /c dir", "powershell -EncodedCommand SQBFAFgA", "notepad a.txt", "powershell -e QUJD", "chrome")
_PARENTS = (r"C:\Office\WINWORD.EXE", r"C:\Windows\explorer.exe", r"C:\Office\EXCEL.EXE")
_X = "'x'"
_INSERTS = [_X] * 20
_INSERTS[0] = "CASE WHEN event_id % 4 = 0 THEN '' ELSE '-' END"
_INSERTS[3] = "CAST(user_id AS VARCHAR)"
_INSERTS[4] = _pick(_IMAGES, "user_id % 4")
_INSERTS[10] = _pick(_COMMANDS, "user_id % 5")
_INSERTS[12] = _NAME
_INSERTS[19] = _pick(_PARENTS, "event_id % 3")

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql)


_cte("raw", (), f"""
SELECT event_id AS record_id, user_id, event_type, value,
  CASE WHEN event_type = 'signup' THEN 'Sysmon' ELSE 'Security' END AS log_source,
  CASE WHEN event_type = 'signup' AND user_id % 10 = 9 THEN '5' WHEN event_type = 'signup' THEN '1'
       WHEN event_type = 'error' THEN '4625' WHEN event_type = 'click' THEN '4624'
       WHEN event_type = 'view' THEN '4634' WHEN event_type = 'purchase' THEN '4672' END AS event_id,
  ts AS event_time,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'signup' THEN ' '
    WHEN event_type = 'error' THEN concat('An account failed to log on.', {NL}, {NL}, 'Subject:', {NL}, {TAB},
      'Account Name:', {TAB}, {TAB}, {_NAME}, {NL}, {NL}, 'Network Information:', {NL}, {TAB},
      'Source Network Address:', {TAB}, {_IP}, {NL}, {TAB}, 'Source Port:', {TAB}, '0')
    WHEN event_type = 'click' THEN concat('An account was successfully logged on.', {NL}, {NL}, 'User Name:', {TAB},
      {_NAME}, {NL}, 'Source Network Address:', {TAB}, {_IP}, {NL})
    WHEN event_type = 'view' THEN concat('An account was logged off. User ', {_NAME}, ' Event ID: 4634')
    ELSE concat('Special privileges assigned. Account Name ', {_NAME}) END AS raw_message,
  CASE WHEN event_type = 'signup' THEN [{', '.join(_INSERTS)}]
       WHEN event_id % 3 = 0 THEN [{_NAME}, '', {_IP}] END AS inserts,
  CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN concat('C:\\xml\\tool', user_id % 3, '.exe') END AS xml_image,
  CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN {_NAME} END AS xml_user
FROM events""")

_cte("msg", ("raw",), rf"""
SELECT *, CASE WHEN regexp_matches(raw_message, '\S') THEN raw_message
               WHEN len(inserts) > 0 THEN array_to_string(inserts, ' | ')
               ELSE 'Message could not be retrieved' END AS message,
  list_filter(inserts, lambda a: a <> '') AS vals, epoch_us(event_time) AS us
FROM raw""")

_cte("prep", ("msg",), f"""
SELECT *,
  CASE WHEN event_id IN ('1', '5') AND log_source = 'Sysmon' THEN coalesce(xml_image, vals[5], 'N/A') END AS image,
  CASE WHEN event_id = '1' AND log_source = 'Sysmon' THEN coalesce(vals[11], 'N/A') END AS command_line,
  CASE WHEN event_id = '1' AND log_source = 'Sysmon' THEN coalesce(xml_user, vals[13], 'N/A') END AS proc_user,
  CASE WHEN event_id = '1' AND log_source = 'Sysmon' THEN coalesce(vals[20], 'N/A') END AS parent_image,
  CASE WHEN event_id = '5' AND log_source = 'Sysmon' THEN coalesce(vals[4], 'N/A') END AS process_id
FROM msg""")

_cte("full_text", ("prep",), f"""
SELECT *, concat(message,
  CASE WHEN image IS NULL THEN ''
    WHEN event_id = '1' THEN concat({NL}, 'Sysmon Process Creation Details:', {NL}, '  Image: ', image, {NL}, '  CommandLine: ',
      command_line, {NL}, '  User: ', proc_user, {NL}, '  ParentImage: ', parent_image, {NL})
    ELSE concat({NL}, 'Sysmon Process Terminated Details:', {NL}, '  Image: ', image, {NL}, '  ProcessId: ', process_id, {NL}) END,
  CASE WHEN len(vals) > 0 THEN concat({NL}, 'Additional Details (StringInserts): ', array_to_string(vals, ' | ')) ELSE '' END
  ) AS combined_text
FROM prep""")

_cte("with_ips", ("full_text",), f"""
SELECT *, list_filter(ips, lambda a: NOT {_private('a')}) AS public_ips
FROM (SELECT *, {_ips('combined_text')} AS ips FROM full_text)""")

_cte("context", ("full_text",), f"""
SELECT *, concat('Log Source: ', log_source, {NL}, 'Event ID: ', event_id, {NL}, 'Time: ',
  strftime(event_time, '%Y-%m-%d %H:%M:%S'), {NL}, 'Message: ', combined_text, {NL}, {NL},
  'Hint: account, workstation, source address and logon type in the message matter most.') AS context_text
FROM full_text""")

_LABEL = _pick(("High", "Yüksek", "Medium", "Düşük", None, "Low risk", "Critical", "unknown"), "CAST(floor(value) AS BIGINT) % 8")
_cte("logs", ("msg",), f"""
SELECT *, CASE WHEN risk_score_raw IS NOT NULL THEN {_display('risk_score_raw')} END AS risk_score
FROM (SELECT record_id AS id, date_trunc('second', event_time) AS "timestamp", event_id, left(message, 500) AS message,
  CASE WHEN user_id % 3 <> 0 THEN concat('Summary: ', event_type, ' by User', user_id) END AS ai_analysis,
  {_LABEL} AS risk_score_raw,
  {_pick((None, "T1110", "T1059.001, T1204.002, T1027", "T1078"), "user_id % 4")} AS mitre_technique
  FROM msg)""")

_cte("feed", (), f"""
SELECT ip, category, CAST(confidence AS INTEGER) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY row_no DESC) AS rn FROM (
    SELECT CASE WHEN c_custkey % 13 = 5 THEN '' ELSE {_ip('c_custkey % 200', '(c_custkey // 200) % 5')} END AS ip,
      {_pick(("Botnet", "BruteForce", "Benign", "Malware", "benign"), "c_custkey % 5")} AS category,
      CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 3 THEN NULL ELSE 50 + c_custkey % 50 END AS confidence,
      c_custkey AS row_no FROM customer)
  WHERE ip <> '' AND lower(category) <> 'benign' AND confidence <> 0) WHERE rn = 1""")

_cte("local_kb", (), f"""
SELECT CASE n_nationkey WHEN 0 THEN '4672' WHEN 1 THEN '1' ELSE CAST(4620 + n_nationkey AS VARCHAR) END AS event_id,
  concat('Own ', n_name) AS title, n_name AS description,
  CASE WHEN n_nationkey % 3 = 1 THEN 'Orta' ELSE 'Yüksek' END AS risk_level,
  CASE WHEN n_nationkey % 4 <> 0 THEN concat('Check ', n_name) ELSE 'Bu olay özel olarak tanımlanmıştır.' END AS advice,
  'local' AS source FROM nation""")

_cte("external_kb", (), f"""
SELECT event_id,
  coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, CASE WHEN p_partkey % 2 = 0 THEN p_brand END, concat('Event ', raw_id)) AS title,
  CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE '' END AS description,
  CASE WHEN p_partkey % 4 IN (0, 3) THEN 'Yüksek' WHEN p_partkey % 5 IN (1, 2) THEN 'Yüksek'
       WHEN p_partkey % 5 = 0 THEN 'Düşük' ELSE 'Orta' END AS risk_level,
  CASE WHEN p_partkey % 6 = 0 THEN concat('Advice ', p_partkey) WHEN p_partkey % 2 = 1 THEN concat('Recommended ', p_partkey)
       ELSE 'Olayın kaynağını ve kullanıcıyı doğrulayın.' END AS advice,
  'external' AS source
FROM (SELECT *, CAST(4600 + p_partkey % 120 AS VARCHAR) AS event_id,
  CASE WHEN p_partkey % 5 = 0 THEN concat(' ', 4600 + p_partkey % 120, ' ') ELSE CAST(4600 + p_partkey % 120 AS VARCHAR) END AS raw_id,
  row_number() OVER (PARTITION BY p_partkey % 120 ORDER BY p_partkey DESC) AS rn
  FROM part WHERE p_partkey % 17 <> 3) WHERE rn = 1""")

_cte("kb", ("local_kb", "external_kb"), """
SELECT * FROM local_kb UNION ALL
SELECT * FROM external_kb WHERE event_id NOT IN (SELECT event_id FROM local_kb)""")

_cte("packets", (), f"""
SELECT l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS ts,
  CASE WHEN hw THEN concat('aa:bb:', l_suppkey % 50) ELSE {_ip('l_suppkey % 200', 'l_linenumber % 5')} END AS source_ip,
  CASE WHEN hw THEN concat('cc:dd:', l_partkey % 50) ELSE {_ip('l_partkey % 200', 'l_orderkey % 5')} END AS dest_ip,
  CASE WHEN hw THEN 'Ethernet' WHEN l_returnflag = 'A' THEN 'TCP' WHEN l_returnflag = 'N' THEN 'UDP'
       WHEN l_linenumber % 2 = 0 THEN 'ICMP' WHEN l_partkey % 2 = 0 THEN '47' ELSE '0' END AS protocol,
  CASE WHEN NOT hw AND l_returnflag IN ('A', 'N') THEN {_pick((443, 80, 22, 3389, 445, 0, 8080, 53), "l_partkey % 8")} END AS port,
  CAST(floor(l_quantity) AS INTEGER) AS length
FROM (SELECT *, l_linenumber = 7 AND l_partkey % 3 = 0 AS hw FROM lineitem)""")

_cte("counts", ("packets",), """
SELECT dimension, value, count(*) AS packets, min(seq) AS first_seen FROM (
  SELECT 'source_ip' AS dimension, source_ip AS value, ts, seq FROM packets
  UNION ALL SELECT 'dest_ip', dest_ip, ts, seq FROM packets
  UNION ALL SELECT 'port', CAST(port AS VARCHAR), ts, seq FROM packets WHERE port <> 0
  UNION ALL SELECT 'protocol', protocol, ts, seq FROM packets WHERE protocol <> '0')
WHERE value <> '' GROUP BY ALL""")

_cte("top", ("counts",), """
SELECT dimension, CAST(place AS INTEGER) AS place, value, packets FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY packets DESC, first_seen, value) AS place FROM counts)
WHERE place <= 10""")

_cte("conns", (), f"""
SELECT concat('h', o_custkey % 50) AS host, {_pick((21, 23, 445, 3389, 80, 443, 22, 5353, 8080, 40001, 40002, 631), "o_orderkey % 12")} AS port,
  CASE WHEN o_orderkey % 20 = 10 THEN 0 WHEN o_orderkey % 10 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1000000 ELSE 0 END END AS pid
FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderstatus <> 'P'""")

_cte("catalogue", (), """
SELECT port, service, risk, description FROM (
  SELECT *, row_number() OVER (PARTITION BY port ORDER BY priority, service) AS rn FROM (
    SELECT port, service, 'High' AS risk, concat(service, ' service - Should be carefully monitored from security perspective') AS description, 1 AS priority
    FROM (VALUES (21, 'FTP'), (23, 'Telnet'), (445, 'SMB'), (3389, 'RDP'), (1433, 'MSSQL'), (3306, 'MySQL'), (5432, 'PostgreSQL'),
      (5900, 'VNC'), (8080, 'HTTP Proxy'), (135, 'MSRPC'), (139, 'NetBIOS')) h(port, service)
    UNION ALL
    SELECT port, service, 'Low', concat(service, ' service - Generally safe'), 2
    FROM (VALUES (80, 'HTTP'), (443, 'HTTPS'), (22, 'SSH'), (25, 'SMTP'), (53, 'DNS'), (110, 'POP3'), (143, 'IMAP'), (993, 'IMAPS'), (995, 'POP3S')) s(port, service)
    UNION ALL
    SELECT CAST(CASE WHEN p_partkey = 190 THEN 443 ELSE 30 * p_partkey + 1 END AS INTEGER), upper(replace(p_name, ' ', '_')), 'Low',
      concat(upper(replace(p_name, ' ', '_')), ' service'), 3 FROM part)) WHERE rn = 1""")

_cte("open_ports", ("conns", "catalogue"), """
SELECT c.host, c.port, c.pid, CASE WHEN coalesce(c.pid, 0) = 0 THEN 'Unknown' ELSE coalesce(p.application, 'Access Denied') END AS application, coalesce(k.service, 'Unknown') AS service,
  coalesce(k.risk, 'Low') AS risk, coalesce(k.description, 'Unknown service') AS description
FROM conns c LEFT JOIN catalogue k ON c.port = k.port
LEFT JOIN (SELECT concat('h', c_custkey % 50) AS host, c_custkey AS pid, concat('app', c_custkey % 20, '.exe') AS application FROM customer) p
  ON c.host = p.host AND c.pid = p.pid""")

_BODY = f"""concat('{{', CASE WHEN k % 7 = 6 THEN '"risk_score": 5' ELSE concat('"risk_score": "', label, '"') END,
  ', "user_entity": "', role, '", "summary": "', regexp_replace(text, '[^A-Za-z ]', '', 'g'), '"',
  CASE WHEN k % 7 = 3 THEN '' ELSE concat(', "advice": "Review turn ', turn, '"') END,
  CASE WHEN k % 7 = 5 THEN ', "event_id_explanation": "Known event"' ELSE '' END, CASE WHEN k % 7 = 4 THEN '' ELSE '}}' END)"""
_cte("answers", (), f"""
SELECT record_id, event_id, ok AS parsed, CASE WHEN ok THEN {_answer('label')} ELSE 'Medium' END AS analysis_risk,
  CASE WHEN ok THEN concat(CASE WHEN k % 7 = 5 THEN concat('🆔 Event ID Explained', {NL}, 'Known event', {NL}, {NL}) ELSE '' END,
      '🕵️‍♂️ Analysis', {NL}, 'User/Entity: ', role, {NL}, 'Summary: ', regexp_replace(text, '[^A-Za-z ]', '', 'g'), {NL},
      'Risk Level: ', {_answer('label')}, {NL}, {NL}, '💡 Recommendation', {NL}, 'Review turn ', turn) END AS good_text,
  raw_response
FROM (SELECT *, json_valid(body) AND k % 7 NOT IN (3, 6) AS ok,
    {_strip(f"CASE k % 7 WHEN 1 THEN concat('Here it is:', {NL}, '```json', {NL}, body, {NL}, '```', {NL}, 'Done') WHEN 2 THEN concat('```', {NL}, body, {NL}, '```') ELSE body END")} AS raw_response
  FROM (SELECT *, k AS record_id, CAST(k % 100 AS VARCHAR) AS event_id, {_BODY} AS body
    FROM (SELECT *, conv_id * 100 + turn AS k,
      {_pick(("Low", "Medium", "High", "Yüksek", "Orta", "Düşük", "highly", "", "important"), "length(text) % 9")} AS label
      FROM conversations)))""")


def _fallback(event_id: str, reason: str) -> str:
    return f"""concat('🆔 Event ID Explained', {NL}, 'This Event ID (', {event_id}, ') is an event recorded by the Windows security system.', {NL}, {NL},
  '🕵️‍♂️ Analysis', {NL}, 'User/Entity: Could Not Be Analyzed', {NL}, 'Summary: ', {reason}, {NL}, 'Risk Level: Medium', {NL}, {NL},
  '💡 Recommendation', {NL}, 'Check the log message manually or contact the system administrator.')"""


def _running(where: str, key: str, window_s: int, source: str = "facts") -> str:
    """Rows of ``source`` that pass, with the number of them in the window up to each."""
    return f"""SELECT record_id, row_number() OVER (PARTITION BY {key} ORDER BY us, log_source, record_id)
  - count(*) OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {window_s * 1_000_000} PRECEDING) AS n
FROM {source} WHERE {where}"""


_PRIV = rf"event_id = '4672' AND regexp_matches(message, '(?i)account name\s+user1') AND (uname IS NULL OR upper(uname) NOT IN ('USER10', 'USER11'))"
_ENC = r"log_source = 'Sysmon' AND event_id = '1' AND regexp_matches(command_line, '(?i)-EncodedCommand|-e\s+[A-Za-z0-9+/=]+')"
_FINE = "event_id = '1' AND regexp_matches(image, '(?i)cmd|powershell')"
_BF = "event_id = '4625' AND lower(log_source) = 'security'"

_cte("facts", ("with_ips",), f"SELECT *, {USER} AS uname FROM with_ips")
_cte("n_fine", ("facts",), _running(_FINE, "concat(event_id, ':', image)", 14400))
_cte("n_bf", ("facts",), _running(_BF, "event_id", 7200))
_cte("n_bf_hosts", ("facts",), _running(_BF, "event_id", 7200).replace("us, log_source, record_id)", "us, log_source, record_id // 2, record_id % 2)"))
_cte("n_coarse", ("facts",), _running("event_id = '1'", "event_id", 7200))
_cte("n_coarse_masked", ("facts", "n_fine"), _running(
    "event_id = '1' AND record_id NOT IN (SELECT record_id FROM n_fine WHERE n >= 4)", "event_id", 7200))
_cte("first_rule", ("facts", "n_fine", "n_bf", "n_coarse_masked"), f"""
SELECT f.*, CASE WHEN a.n >= 4 THEN 'fine' WHEN c.n >= 5 THEN 'coarse' WHEN b.n >= 8 THEN 'bf'
  WHEN {_ENC} THEN 'encoded' WHEN {_PRIV} THEN 'privileges' WHEN log_source = 'Sysmon' THEN 'any_sysmon' END AS rule_id
FROM facts f LEFT JOIN n_fine a USING (record_id) LEFT JOIN n_coarse_masked c USING (record_id) LEFT JOIN n_bf b USING (record_id)""")

_cte("hits", ("with_ips", "feed"), """
SELECT record_id, log_source, arg_min(struct_pack(ip := e.ip, category := feed.category, confidence := feed.confidence), e.pos) AS threat
FROM (SELECT record_id, log_source, unnest(public_ips) AS ip, generate_subscripts(public_ips, 1) AS pos FROM with_ips) e
JOIN feed ON e.ip = feed.ip GROUP BY ALL""")

_RISK_OF = "CASE rule_id WHEN 'fine' THEN 'High' WHEN 'coarse' THEN 'High' WHEN 'bf' THEN 'High' WHEN 'encoded' THEN 'High' WHEN 'privileges' THEN 'Medium' WHEN 'any_sysmon' THEN 'Low' END"
_MITRE_OF = "CASE rule_id WHEN 'fine' THEN 'T1059' WHEN 'bf' THEN 'T1110' WHEN 'encoded' THEN 'T1027' END"
_TEXT_OF = """CASE rule_id WHEN 'fine' THEN 'Interpreter started again and again' WHEN 'bf' THEN 'Many failed logons'
  WHEN 'coarse' THEN '🔴 Detection Rule Match: Many processes' WHEN 'encoded' THEN '🔴 Detection Rule Match: Encoded command'
  WHEN 'privileges' THEN '🔴 Detection Rule Match: Privileges for some users' WHEN 'any_sysmon' THEN '🔴 Detection Rule Match: Any process event' END"""

_SCORED = f"""
SELECT *, {_display('final_risk_raw')} AS final_risk,
  concat(CASE WHEN final_risk_raw IN ('High', 'Yüksek') AND len(public_ips) > 0
      THEN concat('🛡️ [ACTION TAKEN]: IP adres(ler)i engellendi: ', array_to_string(public_ips, ', '), {NL}, {NL}) ELSE '' END,
    CASE WHEN threat IS NOT NULL THEN concat('🚨 [THREAT INTEL MATCH] IP ', threat.ip, ' zararlı listede bulundu! Kategori: ', threat.category,
        ', Güven: ', threat.confidence, '%', {NL}, {NL}, analysis)
      WHEN rule_id IS NOT NULL THEN concat({_TEXT_OF}, {NL}, {NL}, '---', {NL}, {NL}, analysis) ELSE analysis END) AS final_analysis
FROM (SELECT r.*, h.threat, {_MITRE_OF} AS mitre,
    CASE WHEN h.threat IS NOT NULL OR {_RISK_OF} = 'High' THEN 'High' ELSE coalesce(a.analysis_risk, 'Medium') END AS final_risk_raw,
    CASE WHEN a.record_id IS NULL THEN {_fallback('r.event_id', "'AI Error: no analysis available'")}
         WHEN a.parsed THEN a.good_text ELSE {_fallback('r.event_id', 'a.raw_response')} END AS analysis
  FROM first_rule r LEFT JOIN hits h ON r.record_id = h.record_id AND r.log_source = h.log_source
  LEFT JOIN answers a ON r.record_id = a.record_id AND r.log_source = CASE WHEN a.record_id % 2 = 0 THEN 'Security' ELSE 'Sysmon' END)"""
_cte("scored", ("first_rule", "hits", "answers"), _SCORED)

_cte("blocked", (), f"SELECT DISTINCT {_ip('s_suppkey % 200', '(s_suppkey // 200) % 5')} AS ip FROM supplier")

_cte("labels_in", (), f"""
SELECT doc_id, {_pick(("important", " HIGH ", "Following", "YÜKSEK risk", "orta", "Critical", "", "n/a", None, "düşük", "Medium-Low"), "len(words) % 11")}
  || CASE WHEN len(words) % 2 = 0 THEN concat(' ', words[-1]) ELSE '' END AS label
FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)""")


def _with(*names: str) -> str:
    """WITH clause of the named tables and everything they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in ordered) + "\n"


def _sql(name: str, needs: tuple[str, ...], select: str) -> None:
    ORACLE[name] = (_with(*needs) if needs else "") + select.strip()


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')".format

_sql("s2_incremental_read", ("raw",), "SELECT record_id, log_source, epoch_us(event_time) AS event_us FROM raw WHERE event_time > TIMESTAMP '2024-01-19 23:59:55'")
_sql("s3_merge_order", ("raw",), f"""
SELECT {_TS('h')} AS hour, log_source, record_id, events FROM (
  SELECT date_trunc('hour', event_time) AS h, log_source, record_id,
    count(*) OVER (PARTITION BY date_trunc('hour', event_time)) AS events,
    row_number() OVER (PARTITION BY date_trunc('hour', event_time) ORDER BY event_time DESC, log_source DESC, record_id DESC) AS rn
  FROM raw) WHERE rn = 1""")
_sql("u1_channel_union", ("raw",), "SELECT log_source, event_id, count(*) AS events FROM raw GROUP BY ALL")
_sql("s4_added_column", ("logs",), "SELECT m AS mitre_technique, count(*) AS log_count FROM (SELECT CASE WHEN id % 2 <> 0 THEN mitre_technique END AS m FROM logs) GROUP BY ALL")
_sql("s5_rows_to_append", ("raw",), "SELECT record_id AS id, epoch_us(date_trunc('second', event_time)) AS timestamp_us, event_id FROM raw")
_sql("s6_scan_ordered", ("logs",), f'SELECT id, {_TS(chr(34) + "timestamp" + chr(34))} AS "timestamp", event_id, risk_score_raw FROM logs ORDER BY logs."timestamp", id LIMIT 200')
_sql("s8_threat_feed", ("feed",), "SELECT * FROM feed")
_sql("s9_knowledge_list", ("external_kb",), "SELECT risk_level, count(*) AS entries FROM external_kb GROUP BY ALL")
_sql("s10_rule_catalogue", ("raw",), """
SELECT rule_id, severity, event_id, events FROM (VALUES ('coarse', 'high', '1'), ('bf', 'high', '4625'), ('fine', 'critical', '1'),
  ('privileges', 'medium', '4672'), ('encoded', 'high', '1')) r(rule_id, severity, event_id)
JOIN (SELECT event_id, count(*) AS events FROM raw GROUP BY ALL) USING (event_id)""")
_sql("s14_packets", ("packets",), "SELECT protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY ALL")
_sql("s15_connections", ("conns",), "SELECT host, count(*) AS sockets, count(DISTINCT port) AS ports FROM conns GROUP BY ALL")

_sql("f1_enabled_gate", ("facts",), f"""
SELECT 'any_sysmon' AS rule_id, count(*) AS events FROM facts WHERE log_source = 'Sysmon'
UNION ALL SELECT 'privileges', count(*) FROM facts WHERE {_PRIV}""")
_sql("f2_provider", ("raw",), "SELECT record_id FROM raw WHERE lower(log_source) = 'sysmon'")
_sql("f3_event_id", ("raw",), "SELECT record_id FROM raw WHERE event_id = '4672'")
_sql("f4_message_regex", ("msg",), r"SELECT record_id, event_id FROM msg WHERE regexp_matches(message, '(?im)^\s*source network ADDRESS:\s+1\d\.\d+\.[12]\.\d+$')")
_sql("f5_process_regex", ("prep",), r"""
SELECT event_id, count(*) AS events, CAST(sum(record_id) AS BIGINT) AS id_sum FROM prep
WHERE (image IS NULL OR regexp_matches(image, '(?i)\\(cmd|powershell|tool[01])\.EXE$'))
  AND (command_line IS NULL OR regexp_matches(command_line, '(?i)\bdir\b|\s-e\s'))
  AND (parent_image IS NULL OR regexp_matches(parent_image, '(?i)office')) GROUP BY ALL""")
_sql("f6_user_filters", ("facts",), """
SELECT record_id FROM facts WHERE uname IS NULL OR (upper(uname) NOT IN ('SYSTEM', 'USER3') AND upper(uname) IN ('USER1', 'USER3', '-', 'ACCOUNT'))""")
_sql("f7_single_event_match", ("facts",), f"""
SELECT record_id, 'any_sysmon' AS rule_id FROM facts WHERE log_source = 'Sysmon'
UNION ALL SELECT record_id, 'privileges' FROM facts WHERE {_PRIV}
UNION ALL SELECT record_id, 'encoded' FROM facts WHERE {_ENC}""")
_sql("f8_broken_pattern", ("facts",), f"SELECT 'privileges' AS rule_id, count(*) AS events FROM facts WHERE {_PRIV}")

_sql("j1_first_match", ("first_rule",), f"SELECT record_id, rule_id, {_RISK_OF} AS risk_level, {_MITRE_OF} AS mitre_technique FROM first_rule")
_sql("j1_overlapping_reads", ("first_rule",), "SELECT record_id, rule_id FROM first_rule, range(CASE WHEN record_id % 5 = 0 THEN 2 ELSE 1 END)")
_sql("j1_two_hosts", ("facts", "n_bf_hosts"), f"""
SELECT CASE WHEN record_id % 2 = 0 THEN 'h0' ELSE 'h1' END AS host, record_id // 2 AS record_id,
  CASE WHEN b.n >= 8 THEN 'bf' WHEN {_ENC} THEN 'encoded' WHEN {_PRIV} THEN 'privileges' END AS rule_id
FROM facts LEFT JOIN n_bf_hosts b USING (record_id)""")
_sql("j2_all_matches", ("facts", "n_fine", "n_bf", "n_coarse"), f"""
SELECT f.record_id, array_to_string(list_filter([CASE WHEN log_source = 'Sysmon' THEN 'any_sysmon' END, CASE WHEN c.n >= 5 THEN 'coarse' END,
  CASE WHEN b.n >= 8 THEN 'bf' END, CASE WHEN a.n >= 4 THEN 'fine' END, CASE WHEN {_PRIV} THEN 'privileges' END, CASE WHEN {_ENC} THEN 'encoded' END],
  lambda x: x IS NOT NULL), ',') AS rule_ids
FROM facts f LEFT JOIN n_fine a USING (record_id) LEFT JOIN n_coarse c USING (record_id) LEFT JOIN n_bf b USING (record_id)""")
_cte("large_hits", ("facts",), f"""
SELECT f.record_id, f.us, f.log_source, r.k FROM (SELECT *, regexp_extract(message, 'Source Network Address:\\s+([0-9.]+)', 1) AS address FROM facts) f
JOIN (SELECT k, {_ip('(k // 4)', 'k % 4')} AS address, CASE WHEN k % 7 % 2 = 0 THEN '4625' ELSE '4624' END AS event_id FROM range(5000) t(k)) r
  ON f.address = r.address AND f.event_id = r.event_id""")
_cte("large_fired", ("large_hits",), """
SELECT record_id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, log_source, record_id)
  - count(*) OVER (PARTITION BY k ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 864000000000 PRECEDING) AS n FROM large_hits)
WHERE k % 10 <> 3 OR n >= 2""")
_sql("j1_large_catalogue", ("facts", "large_hits"), f"""
SELECT f.record_id, coalesce('r' || k, CASE WHEN {_ENC.replace("log_source", "f.log_source")} THEN 'encoded' WHEN {_PRIV} THEN 'privileges' WHEN f.log_source = 'Sysmon' THEN 'any_sysmon' END) AS rule_id
FROM facts f LEFT JOIN (SELECT record_id, k FROM large_hits WHERE k % 10 <> 3) h ON f.record_id = h.record_id""")
_sql("j2_large_catalogue", ("facts", "n_fine", "n_bf", "n_coarse", "large_fired"), f"""
SELECT rule_id, count(*) AS events FROM (
  SELECT 'r' || k AS rule_id FROM large_fired
  UNION ALL SELECT unnest([CASE WHEN log_source = 'Sysmon' THEN 'any_sysmon' END, CASE WHEN c.n >= 5 THEN 'coarse' END,
    CASE WHEN b.n >= 8 THEN 'bf' END, CASE WHEN a.n >= 4 THEN 'fine' END, CASE WHEN {_PRIV} THEN 'privileges' END, CASE WHEN {_ENC} THEN 'encoded' END])
  FROM facts f LEFT JOIN n_fine a USING (record_id) LEFT JOIN n_coarse c USING (record_id) LEFT JOIN n_bf b USING (record_id))
WHERE rule_id IS NOT NULL GROUP BY rule_id""")
_sql("j2_overlapping_reads", ("facts", "n_fine", "n_bf", "n_coarse"), f"""
SELECT f.record_id, array_to_string(list_filter([CASE WHEN log_source = 'Sysmon' THEN 'any_sysmon' END, CASE WHEN c.n >= 5 THEN 'coarse' END,
  CASE WHEN b.n >= 8 THEN 'bf' END, CASE WHEN a.n >= 4 THEN 'fine' END, CASE WHEN {_PRIV} THEN 'privileges' END, CASE WHEN {_ENC} THEN 'encoded' END],
  lambda x: x IS NOT NULL), ',') AS rule_ids
FROM facts f LEFT JOIN n_fine a USING (record_id) LEFT JOIN n_coarse c USING (record_id) LEFT JOIN n_bf b USING (record_id), range(CASE WHEN f.record_id % 5 = 0 THEN 2 ELSE 1 END)""")
_sql("w1_threshold_alerts", ("facts", "n_bf"), """
SELECT record_id, us AS event_us, event_id AS threshold_key, 'bf' AS rule_id FROM facts JOIN n_bf USING (record_id) WHERE n >= 8""")
ORACLE["w1_threshold_ties"] = (
    _with("raw")
    + ", coarse AS (SELECT record_id, log_source, event_id, (epoch_us(event_time) // 14400000000) * 14400000000 AS us FROM raw), n AS ("
    + _running(_BF, "event_id", 7200, "coarse")
    + ") SELECT record_id, us AS event_us FROM coarse JOIN n USING (record_id) WHERE n >= 8"
)
ORACLE["w2_threshold_keys"] = (
    _with("prep")
    + ", n AS ("
    + _running(
        r"event_id = '1' AND regexp_matches(parent_image, '(?i)(winword\.exe|excel\.exe)') AND regexp_matches(image, '(?i)(powershell\.exe|cmd\.exe)')",
        "concat(event_id, ':', parent_image, '->', image)", 86400, "prep")
    + ") SELECT concat(event_id, ':', parent_image, '->', image) AS threshold_key, count(*) AS fired FROM prep JOIN n USING (record_id) WHERE n >= 2 GROUP BY ALL"
)
_sql("w3_rank_choice", ("facts",), f"""
SELECT record_id, CASE WHEN {_ENC} THEN 'encoded' WHEN {_PRIV} THEN 'privileges' WHEN log_source = 'Sysmon' THEN 'any_sysmon' END AS rule_id FROM facts""")

_sql("j3_threat_hits", ("hits",), "SELECT record_id, threat.ip AS ip, threat.category AS category, threat.confidence AS confidence FROM hits")
ORACLE["x1_ips_of_documents"] = f"""
SELECT log_source, record_id, array_to_string(ips, ',') AS ips, array_to_string(list_filter(ips, lambda a: NOT {_private('a')}), ',') AS public_ips
FROM (SELECT log_source, record_id, {_ips('text')} AS ips FROM (
  SELECT 'documents' AS log_source, doc_id AS record_id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)) WHERE len(ips) > 0"""
ORACLE["j3_threat_hits_documents"] = f"""
WITH found AS (SELECT log_source, record_id, list_filter({_ips('text')}, lambda a: NOT {_private('a')}) AS ips FROM (
    SELECT 'documents' AS log_source, doc_id AS record_id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)),
  each AS (SELECT log_source, record_id, unnest(ips) AS ip, generate_subscripts(ips, 1) AS pos FROM found),
  listed AS (SELECT DISTINCT ip FROM each WHERE log_source = 'documents' AND record_id % 2 = 0)
SELECT log_source, record_id, ip, CAST(length(ip) + 50 AS INTEGER) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY log_source, record_id ORDER BY pos) AS nth FROM each SEMI JOIN listed USING (ip)) WHERE nth = 1"""
_sql("j4_knowledge", ("raw", "kb"), "SELECT record_id, title, risk_level, advice, source FROM raw LEFT JOIN kb ON raw.event_id = kb.event_id")
_sql("u3_knowledge_union", ("kb",), "SELECT * FROM kb")
_sql("j5_port_catalogue", ("open_ports",), "SELECT port, service, risk, description, count(*) AS sockets FROM open_ports GROUP BY ALL")
_sql("j6_application", ("open_ports",), "SELECT application, count(*) AS sockets FROM open_ports GROUP BY ALL")
_sql("j7_not_blocked", ("with_ips", "blocked"), """
SELECT DISTINCT ip FROM (SELECT unnest(public_ips) AS ip FROM with_ips) WHERE ip NOT IN (SELECT ip FROM blocked)""")
_sql("j8_packet_reputation", ("packets", "feed"), f"""
SELECT direction, e.ip, CASE WHEN f.wide THEN concat(f.ip, '/24') ELSE f.ip END AS feed_entry, f.category, count(*) AS packets
FROM (SELECT 'source' AS direction, source_ip AS ip FROM packets UNION ALL SELECT 'destination', dest_ip FROM packets) e
JOIN (SELECT *, confidence % 10 = 0 AS wide, regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) AS net FROM feed) f
  ON (NOT f.wide AND e.ip = f.ip) OR (f.wide AND regexp_extract(e.ip, '^(.*)\\.[0-9]+$', 1) = f.net)
GROUP BY ALL""")

_cte("range_feed", (), f"""
SELECT CASE WHEN bits = 32 THEN ip ELSE concat(ip, '/', bits) END AS entry, ({_number('ip')}) >> (32 - bits) AS net, bits, category, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY ip, bits ORDER BY k DESC) AS rn FROM (
  SELECT o_orderkey AS k, {_ip('o_orderkey % 1117', '(o_orderkey // 1117) % 256')} AS ip, {_pick((8, 14, 16, 20, 24, 26, 29, 32), 'o_orderkey % 8')} AS bits,
    {_pick(("Botnet", "Malware", "Scan"), 'o_orderkey % 3')} AS category, 1 + o_orderkey % 100 AS confidence FROM orders)) WHERE rn = 1""")
_cte("numbered_ends", ("packets",), f"""
SELECT *, {_number('ip')} AS n FROM (SELECT direction, ip, count(*) AS packets FROM (
    SELECT 'source' AS direction, source_ip AS ip FROM packets UNION ALL SELECT 'destination', dest_ip FROM packets)
  WHERE regexp_matches(ip, '{VALID}') GROUP BY ALL)""")
_sql("j8_range_feed", ("numbered_ends", "range_feed"), """
SELECT direction, ip, entry AS feed_entry, category, CAST(confidence AS INTEGER) AS confidence, packets
FROM (SELECT *, n >> (32 - bits) AS net FROM numbered_ends, (SELECT DISTINCT bits FROM range_feed)) JOIN range_feed USING (bits, net)""")

_sql("j3_feed_versions", ("with_ips", "feed"), """
SELECT record_id, arg_min(ip, pos) AS ip, arg_min(category, pos) AS category, CAST(arg_min(rated, pos) AS INTEGER) AS confidence FROM (
  SELECT e.record_id, e.log_source, e.pos, f.ip, f.category, f.confidence + CASE WHEN f.confidence % 2 = 0 THEN k ELSE 0 END AS rated
  FROM (SELECT *, CASE WHEN event_time >= TIMESTAMP '2024-01-20 00:00:00' THEN 2 WHEN event_time >= TIMESTAMP '2024-01-12 06:00:00' THEN 1
        WHEN event_time >= TIMESTAMP '2024-01-05 00:00:00' THEN 0 END AS k FROM (
      SELECT record_id, log_source, event_time, unnest(public_ips) AS ip, generate_subscripts(public_ips, 1) AS pos FROM with_ips)) e
  JOIN feed f ON e.ip = f.ip AND (f.confidence + k) % 3 <> 0)
GROUP BY record_id, log_source""")
_sql("a1_total_logs", ("logs",), "SELECT count(*) AS total_logs FROM logs")
_sql("a2_high_risk_logs", ("logs",), "SELECT count(*) AS high_risk_logs FROM logs WHERE risk_score_raw IN ('High', 'Yüksek')")
_sql("a3_latest_detection", ("logs",), f'SELECT {_TS("max(" + chr(34) + "timestamp" + chr(34) + ")")} AS latest_detection FROM logs')
_sql("a4_timeline", ("logs",), f"""
SELECT {_TS('b')} AS time_interval, count(*) AS log_count FROM (
  SELECT time_bucket(INTERVAL '15 minutes', "timestamp") AS b FROM logs WHERE id % 10 <> 0) GROUP BY ALL""")
_sql("a5_risk_distribution", ("logs",), f"SELECT {_bucket('risk_score_raw')} AS risk_level, count(*) AS log_count FROM logs GROUP BY ALL")
_sql("a6_traffic_counts", ("counts",), "SELECT dimension, value, packets FROM counts")
_sql("a6_total_packets", ("packets",), "SELECT count(*) AS total_packets FROM packets")
_sql("a7_active_ips", ("top",), """
SELECT (SELECT count(DISTINCT value) FROM top WHERE dimension IN ('source_ip', 'dest_ip')) AS active_ips,
  (SELECT count(DISTINCT value) FROM counts WHERE dimension IN ('source_ip', 'dest_ip')) AS active_ips_exact""")
_sql("a8_port_summary", ("open_ports",), "SELECT count(*) AS total, count(*) FILTER (risk = 'High') AS high_risk, count(*) FILTER (risk <> 'High') AS low_risk FROM open_ports")
_sql("a9_feed_size", ("feed",), "SELECT count(DISTINCT ip) AS malicious_ips FROM feed")
_sql("a11_capture_span", ("packets",), "SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS uptime_seconds FROM packets")
_sql("a12_techniques", ("logs",), "SELECT technique, count(*) AS log_count FROM (SELECT unnest(string_split(mitre_technique, ', ')) AS technique FROM logs) GROUP BY ALL")

_sql("w4_recent_packets", ("packets",), f"""
SELECT seq, {_TS('ts')} AS ts, source_ip, dest_ip, protocol, port, length FROM (
  SELECT * FROM packets ORDER BY packets.ts DESC, seq DESC, source_ip DESC, dest_ip DESC, port DESC NULLS LAST, length DESC LIMIT 50)""")
_sql("k1_newest_logs", ("logs",), f'SELECT id, {_TS(chr(34) + "timestamp" + chr(34))} AS "timestamp", event_id FROM logs ORDER BY logs."timestamp" DESC, id DESC LIMIT 1000')
_sql("k2_top_talkers", ("top",), "SELECT * FROM top")
_sql("u2_top_ip_union", ("top",), "SELECT DISTINCT value AS ip FROM top WHERE dimension IN ('source_ip', 'dest_ip')")
_K3 = """(SELECT * FROM (SELECT * FROM logs ORDER BY "timestamp" DESC, id DESC LIMIT 50)
  WHERE lower(risk_score_raw) IN ('high', 'yüksek') ORDER BY "timestamp" DESC, id DESC LIMIT 10)"""
_sql("k3_high_risk_digest", ("logs",), f"SELECT id, event_id, risk_score_raw FROM {_K3}")
_sql("k4_ports_by_number", ("open_ports",), "SELECT host, port, pid, application, service, risk FROM open_ports")
_K5 = "(SELECT * FROM open_ports WHERE risk = 'High' ORDER BY port, host, pid NULLS FIRST LIMIT 10)"
_sql("k5_high_risk_ports", ("open_ports",), f"SELECT port, host, pid, service, description FROM {_K5}")

_sql("x1_extract_ips", ("with_ips",), "SELECT record_id, array_to_string(ips, ',') AS ips FROM with_ips")
ORACLE["x2_valid_ipv4"] = """
SELECT ip, count(*) AS n, list_bool_and(list_transform(string_split(ip, '.'), lambda o: CAST(o AS INTEGER) <= 255 AND CAST(CAST(o AS INTEGER) AS VARCHAR) = o)) AS valid
FROM (SELECT concat_ws('.', l_partkey % 300, lpad(CAST(l_partkey % 30 AS VARCHAR), 2, '0'), l_suppkey % 280, l_linenumber) AS ip FROM lineitem) GROUP BY ip"""
ORACLE["x3_private_ip"] = f"""
SELECT ip, count(*) AS n, {_private('ip')} AS private FROM (
  SELECT concat(head, array_to_string(list_slice([l_partkey % 256, l_partkey % 64, l_partkey % 20, l_partkey % 11], 1, 5 - len(string_split(head, '.'))), '.')) AS ip
  FROM (SELECT *, {_pick(("10.", "172.", "192.168.", "192.0.", "198.", "203.0.113.", "100.64.", "169.254.", "127.", ""), "l_orderkey % 10")} AS head FROM lineitem)) GROUP BY ip"""
_sql("x4_user_name", ("facts",), "SELECT record_id, uname AS user_name FROM facts")
_sql("x5_event_id_in_text", ("context",), r"""
SELECT record_id, nullif(regexp_extract(context_text, '(?i)Event ID\s*[:#]?\s*(\d+)', 1), '') AS found,
  nullif(regexp_extract(message, '(?i)Event ID\s*[:#]?\s*(\d+)', 1), '') AS in_message FROM context""")
_sql("x6_event_message", ("msg",), "SELECT record_id, message FROM msg")
_sql("x7_process_created", ("msg",), """
SELECT record_id, coalesce(vals[5], 'N/A') AS "Image", coalesce(vals[11], 'N/A') AS "CommandLine", coalesce(vals[13], 'N/A') AS "User",
  coalesce(vals[20], 'N/A') AS "ParentImage" FROM msg WHERE event_id = '1'""")
_sql("x8_process_xml", ("prep",), """
SELECT record_id, image AS "Image", proc_user AS "User", process_id AS "ProcessId" FROM prep WHERE log_source = 'Sysmon' AND event_id IN ('1', '5')""")
_sql("x9_process_ended", ("prep",), """SELECT record_id, image AS "Image", process_id AS "ProcessId" FROM prep WHERE event_id = '5'""")
_sql("x10_context_text", ("context",), "SELECT record_id, context_text FROM context")
ORACLE["x11_shortened"] = "SELECT doc_id, md5(left(text, 500)) AS stored, CAST(length(left(text, 200)) AS INTEGER) AS digest_chars FROM documents"
ORACLE["x12_severity_risk"] = f"""
SELECT severity, event_type, count(*) AS n,
  CASE WHEN severity IN ('critical', 'high') THEN 'High' WHEN severity = 'low' THEN 'Low' ELSE 'Medium' END AS risk,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END AS severity_rank
FROM (SELECT event_type, {_pick(("critical", "high", "medium", "low", "info"), "user_id % 5")} AS severity FROM events) GROUP BY severity, event_type"""
_sql("x13_answer_risk", ("labels_in",), f"SELECT doc_id, {_answer('label')} AS risk FROM labels_in")
_sql("x14_display_risk", ("labels_in",), f"SELECT doc_id, {_display('label')} AS risk FROM labels_in")
_sql("x15_risk_bucket", ("labels_in",), f"SELECT doc_id, {_bucket('label')} AS risk FROM labels_in")
_sql("x16_severity_label", ("labels_in",), f"SELECT doc_id, {_bucket('label', 'Critical')} AS severity FROM labels_in")
_sql("x18_external_knowledge", ("external_kb",), "SELECT * FROM external_kb")
_sql("x19_local_knowledge", ("local_kb",), "SELECT * FROM local_kb")
_sql("x20_flatten_packets", ("packets",), "SELECT source_ip, dest_ip, protocol, port, count(*) AS packets, min(seq) AS first_seq FROM packets GROUP BY ALL")
_sql("x21_packet_view", ("packets",), """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "time", CASE WHEN protocol = '0' THEN 'Unknown' ELSE protocol END AS protocol,
  CASE WHEN port <> 0 THEN CAST(port AS VARCHAR) ELSE 'N/A' END AS port, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY ALL""")
ORACLE["x22_port_text"] = _with("catalogue") + f"""
SELECT u.port, coalesce(service, 'Unknown') AS service, coalesce(risk, 'Low') AS risk, coalesce(description, 'Unknown service') AS description
FROM (SELECT DISTINCT {_pick((21, 23, 445, 3389, 80, 443, 22, 5353, 8080, 40001, 40002, 631), "o_orderkey % 12")} AS port FROM orders) u
LEFT JOIN catalogue c ON u.port = c.port"""
_sql("x23_block_rule_name", ("blocked",), "SELECT ip, concat('wardlake_Block_', replace(ip, '.', '_')) AS rule_name FROM blocked")

_sql("q1_risk_filter", ("logs",), "SELECT id, risk_score FROM logs WHERE regexp_matches(risk_score, '(?i)High|Low')")
_sql("q2_event_id_filter", ("logs",), "SELECT id, event_id FROM logs WHERE regexp_matches(event_id, '(?i)46[27]')")
_FIND = "(" + " OR ".join(
    f"coalesce(regexp_matches(lower({c}), '%s'), false)" for c in ("message", "ai_analysis", "mitre_technique")) + ")"
_sql("q3_text_search", ("logs",), "SELECT id FROM logs WHERE " + _FIND % ((r"user1[0-4]\b|t1204",) * 3))
_sql("q4_all_filters", ("logs",), "SELECT id, event_id, risk_score FROM logs WHERE regexp_matches(risk_score, '(?i)Medium|High') AND regexp_matches(event_id, '4625') AND " + _FIND % (("user2",) * 3))
_sql("q5_log_view", ("logs",), f"""
SELECT {_TS(chr(34) + "timestamp" + chr(34))} AS "time", event_id, {_bucket('risk_score_raw', 'Critical')} AS severity,
  {_display('risk_score_raw')} AS risk_level, mitre_technique, message FROM logs""")

_cte("single_rule", ("facts",), f"""
SELECT *, CASE WHEN {_ENC} THEN 'encoded' WHEN {_PRIV} THEN 'privileges' WHEN log_source = 'Sysmon' THEN 'any_sysmon' END AS rule_id FROM facts""")
_cte("scored_single", ("single_rule", "hits", "answers"), _SCORED.replace("FROM first_rule r", "FROM single_rule r"))

_sql("s12_export_rows", ("logs",), f"""
SELECT id, risk_score_raw, {_bucket('risk_score_raw', 'Critical')} AS severity, mitre_technique FROM logs WHERE regexp_matches(risk_score, '(?i)High')""")

_sql("e1_risk_fusion", ("scored",), "SELECT record_id, final_risk_raw, final_risk FROM scored")
_sql("e2_fused_text", ("scored",), "SELECT record_id, md5(final_analysis) AS text_md5 FROM scored")
_sql("e3_parse_answers", ("answers",), "SELECT record_id, parsed, analysis_risk FROM answers")
_sql("e4_render_answers", ("answers",), f"SELECT record_id, CASE WHEN parsed THEN good_text ELSE {_fallback('event_id', 'raw_response')} END AS analysis FROM answers")
_sql("e5_prompts", ("context", "kb"), """
SELECT record_id, c.event_id,
  concat('You assess Windows security events. Answer with one JSON object and nothing else, with the fields risk_score (Low, Medium or High), user_entity, summary, advice and, if useful, event_id_explanation.',
    CASE WHEN kb.event_id IS NOT NULL THEN concat(chr(10), chr(10), 'A fixed procedure exists for event ', c.event_id,
      '. Use this text unchanged as advice: "', kb.advice, '" and this value as risk_score: "', kb.risk_level, '".') ELSE '' END) AS system_prompt,
  concat('Analyze this Windows security log:', chr(10), chr(10), context_text) AS user_prompt
FROM context c LEFT JOIN kb ON c.event_id = kb.event_id""")
_sql("e6_block_list", ("scored", "blocked"), """
SELECT ip, concat('wardlake_Block_', replace(ip, '.', '_')) AS rule_name, min(us) AS first_us, count(DISTINCT record_id) AS events
FROM (SELECT record_id, us, unnest(public_ips) AS ip FROM scored WHERE final_risk_raw IN ('High', 'Yüksek'))
WHERE ip NOT IN (SELECT ip FROM blocked) GROUP BY ip""")
_sql("e7_unblock", ("blocked",), f"""
SELECT ip FROM blocked WHERE ip NOT IN (
  SELECT CASE WHEN c_custkey % 13 = 5 THEN '' ELSE {_ip('c_custkey % 200', '(c_custkey // 200) % 5')} END FROM customer WHERE c_custkey % 5 IN (2, 4))""")
_sql("e8_system_digest", ("logs", "open_ports"), f"""
SELECT 1 AS section, 0 AS line_no, '=== HIGH RISK LOGS ===' AS text
UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS INTEGER),
  concat('- Event ID ', event_id, ' (Time: ', {_TS(chr(34) + "timestamp" + chr(34))}, ')', chr(10), '  Message: ', left(message, 200), chr(10),
    '  AI Analysis: ', coalesce(ai_analysis, 'No analysis'), chr(10), '  Risk: ', risk_score_raw, chr(10)) FROM {_K3}
UNION ALL SELECT 2, 0, '=== HIGH RISK OPEN PORTS ==='
UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY port, host, pid NULLS FIRST) AS INTEGER),
  concat('- Port ', port, ' (', service, ')', chr(10), '  PID: ', coalesce(CAST(pid AS VARCHAR), 'N/A'), chr(10), '  Application: ', application, chr(10),
    '  Description: ', description, chr(10)) FROM {_K5}
UNION ALL SELECT 3, 0, concat('Total Open Ports: ', count(*), chr(10), 'High Risk: ', count(*) FILTER (risk = 'High'), chr(10), 'Low Risk: ', count(*) FILTER (risk <> 'High'), chr(10)) FROM open_ports""")
_sql("e9_process_events", ("scored",), f"""
SELECT record_id AS id, {_TS("date_trunc('second', event_time)")} AS "timestamp", event_id, left(message, 500) AS message,
  md5(final_analysis) AS analysis_md5, final_risk AS risk_score, final_risk_raw AS risk_score_raw, mitre AS mitre_technique FROM scored""")

_sql("e9_rescored", ("scored",), """
SELECT record_id AS id, md5(final_analysis) AS analysis_md5, final_risk AS risk_score, final_risk_raw AS risk_score_raw FROM scored""")
ORACLE["k1_newest_of_table"] = ORACLE["k1_newest_logs"]
ORACLE["s1_read_channel"] = ORACLE["t1_polled_events"] = ORACLE["u1_channel_union"]
_sql("s7_cleared_table", ("logs",), f"""
SELECT id, {_TS(chr(34) + "timestamp" + chr(34))} AS "timestamp", event_id, risk_score, mitre_technique FROM logs WHERE id % 2 = 0""")
_sql("s13_archive_import", ("logs",), f"""
SELECT id, {_TS(chr(34) + "timestamp" + chr(34))} AS "timestamp", event_id, md5(message) AS message_md5 FROM logs""")
ORACLE["t2_stream_dedupe"] = ORACLE["u1_channel_union"]
_sql("t3_stream_first_match", ("first_rule",), "SELECT record_id, rule_id FROM first_rule")
_sql("t8_stream_blocks", ("facts", "hits"), f"""
SELECT DISTINCT ip, concat('wardlake_Block_', replace(ip, '.', '_')) AS rule_name FROM (
  SELECT unnest(public_ips) AS ip, us < (SELECT (min(us) + max(us)) // 2 FROM facts) AS early
  FROM facts f LEFT JOIN hits h ON f.record_id = h.record_id AND f.log_source = h.log_source WHERE h.threat IS NOT NULL OR ({_ENC.replace("log_source", "f.log_source")}))
WHERE NOT early OR length(ip) % 2 = 1""")
_sql("t6_running_rollups", ("scored_single",), f"""
SELECT 'timeline' AS report, {_TS('b')} AS value, count(*) AS log_count FROM (
  SELECT time_bucket(INTERVAL '15 minutes', date_trunc('second', event_time)) AS b FROM scored_single) GROUP BY ALL
UNION ALL SELECT 'risk', {_bucket('final_risk_raw')}, count(*) FROM scored_single GROUP BY ALL
UNION ALL SELECT 'technique', mitre, count(*) FROM scored_single WHERE mitre IS NOT NULL GROUP BY ALL""")
_sql("t4_stream_enrichment", ("raw", "hits", "kb"), """
SELECT e.record_id, h.threat.ip AS ip, h.threat.category AS category, kb.source AS knowledge_source
FROM raw e LEFT JOIN hits h ON e.record_id = h.record_id LEFT JOIN kb ON e.event_id = kb.event_id""")
ORACLE["t5_stream_counters"] = ORACLE["k2_top_talkers"]
_sql("t9_stream_timeline", ("raw",), f"""
SELECT {_TS('b')} AS time_interval, count(*) AS log_count FROM (
  SELECT time_bucket(INTERVAL '15 minutes', event_time) AS b FROM raw) GROUP BY ALL""")
