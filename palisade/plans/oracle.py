"""DuckDB SQL for the registered queries, written against the plain tables.

The seed model the SQL scores with is fitted here by Newton's method on counts
made in plain Python, independently of the Spark training and encoding.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np

from palisade import fixed_values as fv
from palisade.plans.workload import CONFIGS, FORGED_TAGS, OVERLAY, SCORE_DIGITS

NL = "chr(10)"


def quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _chars(ranges) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


def _regex_class(ranges) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


FORMAT_CLASS = _regex_class(fv.FORMAT_CHARS)
SPACE_CLASS = _regex_class(fv.PYTHON_WHITESPACE)
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}]|[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


# --- seed model ----------------------------------------------------------------


def _grams(text: str) -> Counter:
    padded = [f" {w} " for w in text.lower().split()]
    return Counter(
        w[i : i + n] for w in padded for n in (2, 3, 4) for i in range(len(w) - n + 1)
    )


@lru_cache(maxsize=1)
def seed_weights() -> tuple[list[tuple[str, float, float]], float]:
    """((gram, idf, weight), ...) and the intercept.

    With weight vector X'a the problem has one unknown per sample, and at the
    optimum a = C * (label - probability), so 41 unknowns are solved.
    """
    texts = fv.ADVERSARIAL_SEEDS + fv.BENIGN_SEEDS
    labels = np.array([1.0] * len(fv.ADVERSARIAL_SEEDS) + [0.0] * len(fv.BENIGN_SEEDS))
    counts = [_grams(t) for t in texts]
    vocabulary = sorted(set().union(*counts))
    column = {g: j for j, g in enumerate(vocabulary)}
    tf = np.zeros((len(texts), len(vocabulary)))
    for i, c in enumerate(counts):
        for gram, n in c.items():
            tf[i, column[gram]] = 1 + np.log(n)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    x = tf * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    kernel, c, n = x @ x.T, fv.INVERSE_REGULARISATION, len(texts)
    a, b = np.zeros(n), 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(kernel @ a + b)))
        slope = c * p * (1 - p)
        # Residuals of a = C(y - p) and sum(a) = 0, and their Jacobian.
        residual = np.append(a - c * (labels - p), a.sum())
        jacobian = np.block(
            [
                [np.eye(n) + slope[:, None] * kernel, slope[:, None]],
                [np.ones((1, n)), np.zeros((1, 1))],
            ]
        )
        step = np.linalg.solve(jacobian, residual)
        a, b = a - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-14:
            break
    return list(zip(vocabulary, idf.tolist(), (x.T @ a).tolist())), float(b)


# --- shared pieces ---------------------------------------------------------------


def _overlaid(text: str, row_id: str) -> str:
    attacks = ", ".join(quote(t) for t in OVERLAY)
    return f"{text} || ' ' || ([{attacks}])[{row_id} % 12 + 1]"


PROMPTS = f"""prompts AS (
  SELECT conv_id * 8 + turn AS prompt_id, conv_id, turn, role,
         {_overlaid("text", "(conv_id * 8 + turn)")} AS text
  FROM conversations)"""

DOCS = f"""docs AS (
  SELECT doc_id, lang, source, {_overlaid("text", "doc_id")} AS text FROM documents)"""

LABELLED = """labelled AS (
  SELECT d.doc_id, d.lang, d.text, l.toxic AS label
  FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL)"""


def _turn_key(item: str) -> str:
    n = "(SELECT max(conv_id) + 1 FROM conversations)"
    turns = f"(SELECT max(c.turn) + 1 FROM conversations c WHERE c.conv_id = {item} % {n})"
    return f"({item} % {n}) * 8 + ({item} // {n} + {item}) % {turns}"


_FORGED = ", ".join(quote(t) for t in FORGED_TAGS)
PAGE_BLOCKS = f"""blocks AS (
  SELECT {_turn_key("page_id")} AS prompt_id, page_id AS pos,
         html || ([{_FORGED}])[page_id % 3 + 1] AS content,
         CASE page_id % 5 WHEN 1 THEN url || '?q=''a\\b''' WHEN 2 THEN NULL ELSE url END AS source
  FROM pages)"""

DOC_BLOCKS = f"""blocks AS (
  SELECT {_turn_key("doc_id")} AS prompt_id, doc_id AS pos, text AS content, source FROM docs)"""


def _match(rule: fv.Rule) -> str:
    if rule.name == "invisible_characters":
        hit = f"regexp_matches(text, {quote(FORMAT_CLASS)})"
        return f"CASE WHEN {hit} THEN {quote(fv.INVISIBLE_MATCH_TEXT)} ELSE '' END"
    if rule.name == "base64_payload":
        return f"coalesce(({_tokens('text')})[1], '')"
    flag = "" if rule.name in fv.CASE_SENSITIVE_RULES else "(?i)"
    return f"regexp_extract(text, {quote(flag + rule.pattern)}, 0)"


def _tokens(text: str) -> str:
    decoded = "try(decode(from_base64(t)))"
    return (
        f"list_filter(regexp_extract_all({text}, '[A-Za-z0-9+/=]{{40,}}'), lambda t: "
        f"coalesce(NOT regexp_matches({decoded}, {quote(UNPRINTABLE)}), false))"
    )


def _scan(source: str, keys: str) -> str:
    """CTEs ``hits`` and ``scanned`` over a CTE with a text column."""
    matches = ", ".join(f"{_match(r)} AS m{i}" for i, r in enumerate(fv.RULES))
    found = ", ".join(
        f"CASE WHEN m{i} <> '' THEN {{'rule_name': {quote(r.name)}, 'severity': {quote(r.severity)}, "
        f"'matched_text': m{i}, 'description': {quote(r.description)}}} END"
        for i, r in enumerate(fv.RULES)
    )
    high = " OR ".join(f"m{i} <> ''" for i, r in enumerate(fv.RULES) if r.severity == fv.HIGH)
    white = quote(_chars(fv.PYTHON_WHITESPACE))
    return f"""hits AS (SELECT {keys}, text, {matches} FROM {source}),
scanned AS (
  SELECT {keys}, text, list_filter([{found}], lambda f: f IS NOT NULL) AS findings,
         ({high}) AS high,
         trim(regexp_replace(text, {quote(FORMAT_CLASS)}, '', 'g'), {white}) AS cleaned
  FROM hits)"""


RULE_LIST = "array_to_string(list_transform(findings, lambda f: f.rule_name), ',')"


def _long(key: str, extra: str = "") -> str:
    return f"""long AS (
  SELECT {key}{extra}, generate_subscripts(findings, 1) - 1 AS finding_ord, unnest(findings) AS f
  FROM scanned)"""


def _gram_counts(source: str, key: str, text: str) -> str:
    """CTE ``tf``: (key, gram, tf)."""
    cut = (
        "flatten(list_transform([2, 3, 4], lambda n: list_transform("
        "range(1, length(p) - n + 2), lambda i: substring(p, i, n))))"
    )
    return f"""word AS (
  SELECT {key}, ' ' || w || ' ' AS p, count(*) AS c FROM (
    SELECT {key}, unnest(string_split_regex(lower({text}), {quote(SPACE_CLASS + '+')})) AS w
    FROM {source})
  WHERE w <> '' GROUP BY ALL),
tf AS (
  SELECT {key}, gram, sum(c)::BIGINT AS tf
  FROM (SELECT {key}, c, unnest({cut}) AS gram FROM word) GROUP BY ALL)"""


def _scores(source: str, key: str, text: str) -> str:
    """CTE ``scores``: (key, score) under the seed model."""
    weights, intercept = seed_weights()
    values = ", ".join(f"({quote(g)}, {i!r}::DOUBLE, {w!r}::DOUBLE)" for g, i, w in weights)
    return f"""model(gram, idf, weight) AS (VALUES {values}),
{_gram_counts(source, key, text)},
dots AS (
  SELECT {key}, sum(x * weight) / sqrt(sum(x * x)) AS dot
  FROM (SELECT {key}, weight, (1 + ln(tf)) * idf AS x FROM tf JOIN model USING (gram))
  GROUP BY {key}),
scores AS (
  SELECT s.{key}, 1 / (1 + exp(-(coalesce(dot, 0) + {intercept!r}::DOUBLE))) AS score
  FROM {source} s LEFT JOIN dots USING ({key}) WHERE s.{text} IS NOT NULL)"""


def _prediction(threshold: str = "0.5") -> str:
    flagged = f"score >= {threshold}"
    return f"""CASE WHEN {flagged} THEN 'adversarial' WHEN score IS NOT NULL THEN 'benign' END AS label,
  round(CASE WHEN {flagged} THEN score ELSE 1 - score END, {SCORE_DIGITS}) AS confidence,
  round(score, {SCORE_DIGITS}) AS score, format('{{:.1f}}%', score * 100) AS shown,
  CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.45 THEN 'elevated'
       WHEN score IS NOT NULL THEN 'low' END AS risk"""


# --- prompt assembly -------------------------------------------------------------


def _boundary(salt: str) -> str:
    return hashlib.sha256(salt.encode()).hexdigest()[:12]


class _Prompt:
    """SQL pieces of a prompt for one boundary id, given as an SQL expression."""

    def __init__(self, boundary: str):
        self.id = boundary

    def _fill(self, template: str) -> str:
        return f" || {self.id} || ".join(quote(part) for part in template.split("%s"))

    def escape(self, text: str) -> str:
        z = fv.ZERO_WIDTH_SPACE
        own = rf"'(?i)\[(\[/?(?:SYSTEM|TOOL|USER)_' || {self.id} || '\]\])'"
        tokens = quote(f"(?i)({fv.CONTROL_TOKENS})")
        inner = f"regexp_replace({text}, {own}, '{z}[{z}\\1', 'g')"
        return f"regexp_replace({inner}, {tokens}, '[ESCAPED:\\1]', 'g')"

    def block(self, level: str, body: str, note: str = "''") -> str:
        return (
            f"'[[{level}_' || {self.id} || ']]' || {note} || {NL} || {body} || {NL} || "
            f"'[[/{level}_' || {self.id} || ']]'"
        )

    def tool(self, level: str = "'TOOL'") -> str:
        # As Python's repr: double quotes around a source that holds single ones only.
        inner = r"replace(source, '\', '\\')"
        note = (
            f"CASE WHEN contains(source, '''') THEN ' source=\"' || {inner} || '\"' "
            f"WHEN source <> '' THEN ' source=''' || {inner} || '''' ELSE '' END"
        )
        body = self.escape("content")
        if level != "'TOOL'":
            body = f"CASE WHEN {level} = 'SYSTEM' THEN content ELSE {body} END"
        return (
            f"'[[' || {level} || '_' || {self.id} || ']]' || {note} || {NL} || {body} || {NL} || "
            f"'[[/' || {level} || '_' || {self.id} || ']]'"
        )

    def user(self, text: str) -> str:
        return self.block("USER", self.escape(text))

    @property
    def preamble(self) -> str:
        return self._fill(fv.PREAMBLE)

    @property
    def policy(self) -> str:
        return self._fill(fv.POLICY_NOTE)

    def full(self, text: str, rules: str, tools: str = "NULL") -> str:
        system = self.block("SYSTEM", rules)
        between = f"coalesce({tools} || {NL} || {NL}, '')"
        return f"{self.preamble} || {NL} || {system} || {NL} || {NL} || {between} || {self.user(text)}"

    def user_message(self, text: str, tools: str = "NULL") -> str:
        placeholder = self.full(text, "'(see system message)'", tools)
        block = (
            rf"'(?s)\[\[SYSTEM_' || {self.id} || '\]\].*?\[\[/SYSTEM_' || {self.id} || '\]\]\n\n'"
        )
        return f"regexp_replace({placeholder}, {block}, '', 'g')"


DEFAULT = _Prompt(quote(_boundary(fv.DEFAULT_SALT)))
RULES_TEXT = quote(fv.DEFAULT_SYSTEM_RULES)


def _tools(prompt: _Prompt, key: str = "prompt_id", level: str = "'TOOL'", source: str = "blocks") -> str:
    return f"""tools AS (
  SELECT {key}, count(*) AS n_tools, string_agg({prompt.tool(level)}, {NL} || {NL} ORDER BY pos) AS tools
  FROM {source} WHERE content <> '' GROUP BY {key})"""


RAW_PLAIN = f"{quote(fv.BYPASS_RULES_HEADING)} || {RULES_TEXT} || {NL} || {NL} || {quote(fv.BYPASS_USER_HEADING)} || text"


# --- guard -------------------------------------------------------------------------


def _judged(source: str) -> str:
    """CTE ``judged``: the verdicts over CTE ``source`` (prompt_id, text, tools, thr, bs, bi, bypass)."""
    keys = "prompt_id, tools, thr, bs, bi, bypass"
    blocked = "(bs AND high AND NOT bypass)"
    return f"""{_scan(source, keys)},
gated AS (SELECT *, {blocked} AS blocked FROM scanned),
{_scores("gated", "prompt_id", "cleaned")},
judged AS (
  SELECT g.*, CASE WHEN NOT blocked AND NOT bypass THEN score END AS score,
         coalesce(NOT blocked AND NOT bypass AND bi AND score >= thr, false) AS flagged
  FROM gated g LEFT JOIN scores USING (prompt_id))"""


def _guard(source: str) -> str:
    """The whole guard over CTE ``source``."""
    return f"""{_judged(source)}
SELECT prompt_id, bypass OR NOT (blocked OR flagged) AS allowed,
  CASE WHEN bypass THEN {quote(fv.BYPASS_REASON)}
       WHEN blocked THEN {quote(fv.SANITIZER_REASON)} || replace({RULE_LIST}, ',', ', ')
       WHEN flagged THEN {INTENT_REASON} END AS reason_text,
  CASE WHEN blocked THEN {quote(fv.LAYER1_LABEL)} WHEN flagged THEN {quote(fv.LAYER3_LABEL)} END AS blocked_at,
  CASE WHEN bypass THEN '' ELSE {RULE_LIST} END AS rules,
  CASE WHEN bypass THEN 'bypassed' WHEN score >= thr THEN 'adversarial'
       WHEN score IS NOT NULL THEN 'benign' END AS label,
  CASE WHEN bypass THEN 0 ELSE round(CASE WHEN score >= thr THEN score ELSE 1 - score END, {SCORE_DIGITS}) END AS confidence,
  CASE WHEN bypass THEN 0 ELSE round(score, {SCORE_DIGITS}) END AS score,
  CASE WHEN bypass THEN 'low' WHEN score > 0.7 THEN 'high' WHEN score > 0.45 THEN 'elevated'
       WHEN score IS NOT NULL THEN 'low' END AS risk,
  '{{"sanitizer":"' || CASE WHEN bypass THEN 'bypassed' WHEN blocked THEN 'blocked'
       WHEN len(findings) > 0 THEN 'warned' ELSE 'passed' END ||
  '","intent":"' || CASE WHEN bypass THEN 'bypassed' WHEN blocked THEN 'pending' WHEN NOT bi THEN 'disabled'
       WHEN flagged THEN 'blocked' ELSE 'passed' END ||
  '","encapsulation":"' || CASE WHEN bypass THEN 'bypassed' WHEN blocked OR flagged THEN 'aborted' ELSE 'protected' END ||
  '","delivery":"' || CASE WHEN blocked OR flagged THEN 'blocked' ELSE 'completed' END || '"}}' AS stages,
  CASE WHEN bypass THEN md5({RAW_PLAIN})
       WHEN NOT (blocked OR flagged) THEN md5({DEFAULT.full("cleaned", RULES_TEXT, "tools")}) END AS prompt_md5,
  CASE WHEN NOT (bypass OR blocked OR flagged) THEN md5({DEFAULT.user_message("cleaned", "tools")}) END AS user_message_md5
FROM judged"""


INTENT_REASON = "'Blocked by intent classifier (adversarial_score=' || format('{:.2f}', score) || ')'"
PLAIN_SETTINGS = "NULL::VARCHAR AS tools, 0.5 AS thr, true AS bs, true AS bi, false AS bypass"


def _funnel(source: str, by: str) -> str:
    return f"""{_scan(source, by + ", id")},
{_scores("scanned", "id", "cleaned")}
SELECT {by}, count(*) AS total, count(*) FILTER (text IS NULL) AS null_text,
  count(*) FILTER (len(findings) > 0) AS suspicious,
  count(*) FILTER (high) AS l1_blocked,
  count(*) FILTER (NOT high AND score >= 0.5) AS l3_blocked,
  count(*) FILTER (NOT high AND score < 0.5) AS allowed
FROM scanned LEFT JOIN scores USING (id) GROUP BY {by}"""


def _confusion_columns(flag: str) -> str:
    tp, fp = f"({flag} AND label = 1)", f"({flag} AND label <> 1)"
    fn, tn = f"(NOT {flag} AND label = 1)", f"(NOT {flag} AND label <> 1)"
    counts = ", ".join(
        f"count(*) FILTER {c} AS {n}" for c, n in [(tp, "tp"), (fp, "fp"), (fn, "fn"), (tn, "tn")]
    )
    fpr = f"round(count(*) FILTER {fp} / nullif(count(*) FILTER (label <> 1), 0), 6) AS fpr"
    fnr = f"round(count(*) FILTER {fn} / nullif(count(*) FILTER (label = 1), 0), 6) AS fnr"
    return f"{counts}, {fpr}, {fnr}"


def _exposure(prompt: str) -> str:
    has = lambda s: f"contains(lower({prompt}), {quote(s)})"
    protected = " OR ".join(f"contains({prompt}, {quote(m)})" for m in fv.PROTECTION_MARKS)
    return (
        f"CASE WHEN {protected} THEN 'protected' "
        f"WHEN {' AND '.join(has(w) for w in fv.OVERRIDE_WORDS)} THEN 'override' "
        f"WHEN {' OR '.join(has(w) for w in fv.JAILBREAK_WORDS)} THEN 'jailbreak' "
        f"WHEN {' OR '.join(has(w) for w in fv.LEAK_PHRASES)} THEN 'data_leak' "
        f"WHEN {prompt} IS NOT NULL THEN 'none' END"
    )


def _html(text: str) -> str:
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]:
        text = f"replace({text}, {quote(raw)}, {quote(entity)})"
    return text


def build_oracle_sql() -> dict[str, str]:
    prompt_scan = f"WITH {PROMPTS}, {_scan('prompts', 'prompt_id, role')}"
    doc_scan = f"WITH {DOCS}, {_scan('docs', 'doc_id, lang, source')}"
    rule_values = ", ".join(
        f"({i}, {quote(r.name)}, {quote(r.severity)}, {quote(r.description)})"
        for i, r in enumerate(fv.RULES)
    )
    rule_cte = f"rules(rule_ord, rule_name, severity, description) AS (VALUES {rule_values})"
    js_white = quote(_chars(fv.JAVASCRIPT_WHITESPACE))
    sql: dict[str, str] = {}

    sql["scan_prompts"] = f"""{prompt_scan}
SELECT prompt_id, {RULE_LIST} AS rules,
  array_to_string(list_transform(findings, lambda f: f.matched_text), '|') AS matched,
  len(findings) > 0 AS suspicious, high AS blocked FROM scanned"""

    sql["findings_long"] = f"""{prompt_scan}, {_long("prompt_id")}
SELECT prompt_id, finding_ord::INTEGER AS finding_ord, f.rule_name, f.severity, f.matched_text,
  {_html("f.matched_text")} AS matched_html, f.description FROM long"""

    sql["findings_rollup"] = f"""{doc_scan}, {_long("doc_id", ", lang")}, {rule_cte},
langs AS (SELECT DISTINCT lang FROM docs),
lines AS (
  SELECT severity, rule_name FROM rules UNION ALL SELECT DISTINCT severity, NULL FROM rules
  UNION ALL SELECT NULL, NULL)
SELECT g.lang, l.severity, l.rule_name, count(f) AS n_findings, count(DISTINCT doc_id) AS n_rows
FROM langs g CROSS JOIN lines l LEFT JOIN long ON long.lang = g.lang
  AND (l.severity IS NULL OR f.severity = l.severity)
  AND (l.rule_name IS NULL OR f.rule_name = l.rule_name)
GROUP BY ALL"""

    sql["rule_report"] = f"""{doc_scan}, {_long("doc_id")}, {rule_cte}
SELECT rule_name, rule_ord, severity, description, count(f) AS n_findings,
  count(DISTINCT doc_id) AS n_rows
FROM rules LEFT JOIN long ON f.rule_name = rules.rule_name GROUP BY ALL"""

    sql["clean_text"] = f"""{doc_scan}
SELECT doc_id, md5(cleaned) AS cleaned_md5, length(cleaned)::INTEGER AS cleaned_chars FROM scanned"""

    sql["base64_hits"] = f"""WITH {DOCS}
SELECT doc_id, token, decode(from_base64(token)) AS decoded
FROM (SELECT doc_id, unnest({_tokens("text")}) AS token FROM docs)"""

    sql["rag_corpus_scan"] = f"""WITH {DOCS}, items AS (
  SELECT 'page' AS kind, page_id AS item_id, url AS source, {_overlaid("html", "page_id")} AS text FROM pages
  UNION ALL SELECT 'document', doc_id, source, text FROM docs),
{_scan("items", "kind, item_id, source")}
SELECT kind, item_id, source, {RULE_LIST} AS rules, high AS blocked FROM scanned"""

    sql["quarantine"] = f"""{doc_scan}
SELECT doc_id, lang, {RULE_LIST} AS rules, md5(text) AS text_md5 FROM scanned WHERE len(findings) > 0"""
    sql["clean_split"] = f"""{doc_scan}
SELECT doc_id, lang, md5(text) AS text_md5 FROM scanned WHERE len(findings) = 0"""

    full = DEFAULT.full("text", RULES_TEXT, "tools")
    sql["assemble_prompt"] = f"""WITH {PROMPTS}, {PAGE_BLOCKS}, {_tools(DEFAULT)},
built AS (SELECT prompt_id, n_tools, {full} AS p FROM prompts LEFT JOIN tools USING (prompt_id))
SELECT prompt_id, coalesce(n_tools, 0)::INTEGER AS n_tools, length(p)::INTEGER AS prompt_chars, md5(p) AS prompt_md5,
  md5(array_to_string(string_split(p, {NL})[1:{fv.EXCERPT_LINES}], {NL})) AS excerpt_md5 FROM built"""

    salted = _Prompt(quote(_boundary("messages")))
    opened, closed = (f"'[[{end}SYSTEM_{_boundary('messages')}]]'" for end in ("", "/"))
    sql["structured_messages"] = f"""WITH {PROMPTS}, {DOCS}, {DOC_BLOCKS}, trusted AS (
  SELECT prompt_id, pos, CASE WHEN pos % 7 IN (0, 5) THEN 'SYSTEM' ELSE 'TOOL' END AS level,
         CASE pos % 7 WHEN 3 THEN source || {opened} WHEN 4 THEN source || {closed} ELSE source END AS source,
         CASE pos % 7 WHEN 5 THEN content || {closed} || {NL} || {NL} ELSE content END AS content
  FROM blocks), {_tools(salted, level="level", source="trusted")},
built AS (
  SELECT prompt_id, {RULES_TEXT} || {NL} || {NL} || {salted.policy} AS system_message,
         {salted.user_message("text", "tools")} AS user_message
  FROM prompts LEFT JOIN tools USING (prompt_id)),
messages AS (
  SELECT prompt_id, 0 AS ord, 'system' AS role, system_message AS content FROM built
  UNION ALL SELECT prompt_id, 1, 'user', user_message FROM built)
SELECT prompt_id, ord, role, length(content)::INTEGER AS content_chars, md5(content) AS content_md5 FROM messages"""

    head = f"{DEFAULT.preamble} || {NL} || {DEFAULT.block('SYSTEM', RULES_TEXT)}"
    sql["segment_rows"] = f"""WITH {PROMPTS}, {PAGE_BLOCKS}
SELECT prompt_id, 0 AS section, 0::BIGINT AS pos, md5({head}) AS segment_md5 FROM prompts
UNION ALL SELECT prompt_id, 1, pos, md5({DEFAULT.tool()}) FROM blocks
  WHERE content <> '' AND prompt_id IN (SELECT prompt_id FROM prompts)
UNION ALL SELECT prompt_id, 2, 0, md5({DEFAULT.user("text")}) FROM prompts"""

    sql["keyword_tools"] = f"""WITH {PROMPTS}, {DOCS}, {DOC_BLOCKS}, joined AS (
  SELECT prompt_id, count(*) AS n_tools, string_agg(content, {NL} ORDER BY pos) AS content
  FROM blocks WHERE content <> '' GROUP BY prompt_id)
SELECT p.prompt_id, coalesce(n_tools, 0)::INTEGER AS n_tools, md5(content) AS tools_md5
FROM prompts p LEFT JOIN joined j ON p.prompt_id = j.prompt_id AND contains(lower(p.text), 'instructions')"""

    row_id = _Prompt("boundary")
    sql["salted_boundaries"] = f"""WITH {PROMPTS}, ids AS (
  SELECT *, left(sha256('conv-' || conv_id), 12) AS boundary FROM prompts)
SELECT prompt_id, boundary, md5({row_id.full("text", RULES_TEXT)}) AS prompt_md5 FROM ids"""

    raw_tool = (
        f"'Tool Context (source=' || coalesce(nullif(trim(source, {js_white}), ''), 'unspecified') "
        f"|| '):' || {NL} || trim(content, {js_white})"
    )
    raw = (
        f"{quote(fv.BYPASS_RULES_HEADING)} || {RULES_TEXT} || {NL} || {NL} || "
        f"coalesce(tools || {NL} || {NL}, '') || {quote(fv.BYPASS_USER_HEADING)} || text"
    )
    sql["bypass_prompts"] = f"""WITH {PROMPTS}, {PAGE_BLOCKS}, tools AS (
  SELECT prompt_id, string_agg({raw_tool}, {NL} || {NL} ORDER BY pos) AS tools
  FROM blocks WHERE trim(content, {js_white}) <> '' GROUP BY prompt_id),
trimmed AS (SELECT prompt_id, trim(text, {js_white}) AS text FROM prompts),
built AS (SELECT prompt_id, {raw} AS raw FROM trimmed LEFT JOIN tools USING (prompt_id) WHERE text <> '')
SELECT prompt_id, length(raw)::INTEGER AS raw_chars, md5(raw) AS raw_md5 FROM built"""

    sql["exposure_audit"] = f"""WITH {PROMPTS}, paths AS (
  SELECT 'bypass' AS path, role, {RAW_PLAIN} AS prompt FROM prompts
  UNION ALL SELECT 'raw', role, text FROM prompts
  UNION ALL SELECT 'guarded', role, {DEFAULT.full("text", RULES_TEXT)} FROM prompts)
SELECT path, role, {_exposure("prompt")} AS exposure, count(*) AS n FROM paths GROUP BY ALL"""

    sql["gram_lists"] = f"""WITH {PROMPTS}, {_gram_counts("prompts", "prompt_id", "text")}
SELECT prompt_id, sum(tf)::INTEGER AS n_grams, md5(string_agg(gram, '|' ORDER BY gram)) AS grams_md5
FROM tf GROUP BY prompt_id"""

    sql["gram_tf"] = f"""WITH {_gram_counts("documents", "doc_id", "text")}
SELECT doc_id, count(*) AS n_grams, sum(tf)::BIGINT AS total_tf, max(tf) AS max_tf FROM tf GROUP BY doc_id"""

    sql["gram_idf"] = f"""WITH {LABELLED}, {_gram_counts("labelled", "doc_id", "text")}
SELECT gram, count(*) AS df,
  round(ln((1 + (SELECT count(*) FROM labelled)) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY gram"""

    sql["class_weights"] = f"""WITH {LABELLED}
SELECT label, count(*) AS n,
  round((SELECT count(*) FROM labelled) / ((SELECT count(DISTINCT label) FROM labelled) * count(*)), 6) AS weight
FROM labelled GROUP BY label"""

    sql["intent_score"] = f"""{prompt_scan}, {_scores("scanned", "prompt_id", "cleaned")}
SELECT prompt_id, {_prediction()} FROM scores"""
    sql["intent_score_join"] = sql["intent_score"]
    sql["intent_score_documents"] = f"""WITH {_scores("documents", "doc_id", "text")}
SELECT doc_id, {_prediction()} FROM scores"""

    evaluated = f"WITH {LABELLED}, {_scores('labelled', 'doc_id', 'text')}"
    sql["confusion"] = f"""{evaluated}
SELECT lang, {_confusion_columns("score >= 0.5")}
FROM labelled JOIN scores USING (doc_id) GROUP BY lang"""
    steps = ", ".join(f"({t!r}::DOUBLE)" for t in fv.SWEEP_THRESHOLDS)
    sql["threshold_sweep"] = f"""{evaluated}, steps(threshold) AS (VALUES {steps})
SELECT threshold, {_confusion_columns("score >= threshold")}
FROM labelled JOIN scores USING (doc_id) CROSS JOIN steps GROUP BY threshold"""

    sql["settings_sweep"] = f"""WITH {DOCS}, {_scan("docs", "doc_id")}, {_scores("scanned", "doc_id", "cleaned")},
settings AS (
  SELECT id AS setting_id, (id // 4) / 100 AS thr, id % 2 = 1 AS bs, (id // 2) % 2 = 1 AS bi FROM range(400) t(id))
SELECT setting_id, count(*) AS total, count(*) FILTER (bs AND high) AS l1_blocked,
  count(*) FILTER (NOT (bs AND high) AND bi AND score >= thr) AS l3_blocked,
  count(*) FILTER (NOT (bs AND high) AND NOT (bi AND score >= thr)) AS allowed
FROM settings CROSS JOIN (SELECT high, score FROM scanned JOIN scores USING (doc_id)) GROUP BY setting_id"""

    with_tools = f"""WITH {PROMPTS}, {PAGE_BLOCKS}, {_tools(DEFAULT)}, p AS (
  SELECT prompt_id, text, tools, 0.5 AS thr, true AS bs, true AS bi, false AS bypass
  FROM prompts LEFT JOIN tools USING (prompt_id)),"""
    sql["guard_prompts"] = f"{with_tools} {_guard('p')}"
    sql["guarded_segments"] = f"""WITH {PROMPTS}, {PAGE_BLOCKS}, p AS (
  SELECT prompt_id, text, {PLAIN_SETTINGS} FROM prompts), {_judged("p")},
passed AS (SELECT prompt_id, cleaned FROM judged WHERE NOT (blocked OR flagged))
SELECT prompt_id, 0 AS section, 0::BIGINT AS pos, md5({head}) AS segment_md5 FROM passed
UNION ALL SELECT prompt_id, 1, pos, md5({DEFAULT.tool()}) FROM blocks
  WHERE content <> '' AND prompt_id IN (SELECT prompt_id FROM passed)
UNION ALL SELECT prompt_id, 2, 0, md5({DEFAULT.user("cleaned")}) FROM passed"""

    config = ", ".join(f"({quote(c)}, {t!r}::DOUBLE, {s}, {i})" for c, t, s, i in CONFIGS)
    sql["guard_configs"] = f"""WITH {PROMPTS}, config(role, thr, bs, bi) AS (VALUES {config}), p AS (
  SELECT prompt_id, text, NULL::VARCHAR AS tools, coalesce(thr, 0.5) AS thr, coalesce(bs, true) AS bs,
         coalesce(bi, true) AS bi, false AS bypass
  FROM prompts LEFT JOIN config USING (role)), {_guard("p")}"""

    note = DEFAULT.block("TOOL", "'note ' || prompt_id", "' source=''desk'''")
    sql["guard_request_batch"] = f"""WITH {PROMPTS}, p AS (
  SELECT prompt_id, text, CASE WHEN role = 'assistant' THEN {note} END AS tools,
         CASE WHEN role = 'assistant' THEN 0.6 ELSE 0.5 END::DOUBLE AS thr, true AS bs, true AS bi,
         role = 'system' AS bypass
  FROM prompts WHERE prompt_id % 11 NOT IN (3, 5, 7, 9)), {_guard("p")}
UNION ALL SELECT prompt_id, false, {quote(fv.MALFORMED_REASON)}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM prompts WHERE prompt_id % 11 IN (3, 5, 7, 9)"""

    sql["funnel"] = f"""WITH {PROMPTS}, p AS (SELECT prompt_id AS id, role, text FROM prompts),
{_funnel("p", "role")}"""
    sql["funnel_documents"] = f"""WITH {DOCS}, p AS (SELECT doc_id AS id, lang, source, text FROM docs),
{_funnel("p", "lang, source")}"""
    sql["stream_guard"] = f"""WITH {PROMPTS}, p AS (SELECT prompt_id, text, {PLAIN_SETTINGS} FROM prompts),
{_guard("p")}"""
    sql["stored_model_score"] = sql["intent_score"]
    sql["responses_readback"] = f"""WITH {PROMPTS}, p AS (
  SELECT prompt_id, text, {PLAIN_SETTINGS} FROM prompts WHERE role IN ('user', 'system')), {_judged("p")}
SELECT prompt_id, role, NOT (blocked OR flagged) AS allowed,
  CASE WHEN blocked THEN {quote(fv.SANITIZER_REASON)} || replace({RULE_LIST}, ',', ', ') WHEN flagged THEN {INTENT_REASON} END AS reason,
  blocked, md5(cleaned) AS cleaned_md5, array_to_string(list_transform(findings, lambda f: f.matched_text), '|') AS matched,
  round(score, {SCORE_DIGITS}) AS score,
  CASE WHEN NOT (blocked OR flagged) THEN md5({DEFAULT.full("cleaned", RULES_TEXT)}) END AS prompt_md5,
  CASE WHEN NOT (blocked OR flagged) THEN 2 END::INTEGER AS n_messages
FROM judged JOIN (SELECT prompt_id, role FROM prompts) USING (prompt_id)"""
    sql["findings_readback"] = f"""{prompt_scan}, {_long("prompt_id")}
SELECT prompt_id, finding_ord::INTEGER AS finding_ord, f.rule_name, f.severity, f.matched_text FROM long
WHERE f.rule_name IN ('encoding_smuggling', 'base64_payload', 'role_reassignment')"""
    sql["stream_guard_join"] = sql["stream_guard"]
    sql["fit_certificate"] = f"""WITH {LABELLED}, {_gram_counts("labelled", "doc_id", "text")}
SELECT (SELECT count(DISTINCT gram) FROM tf) AS n_grams, count(*) AS n_samples, true AS at_optimum
FROM labelled WHERE text IS NOT NULL"""
    sql["block_fit_certificate"] = sql["fit_certificate"]
    return sql
