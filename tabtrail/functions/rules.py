"""Rule-based categorisation and wellness-type lookup as native Column expressions.

``category_by_url`` compiles each category's patterns into one case-insensitive
alternation and chains them with ``when`` in declaration order, so a row is tested
against at most seven compiled Java regexes inside whole-stage codegen (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabtrail.constants import (
    DEFAULT_WELLNESS_TYPE,
    INTERNAL_URL_PARTS,
    INTERNAL_URL_PREFIXES,
    URL_RULES,
    WELLNESS_TYPE_BY_NAME,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_META = set(".^$*+?()[]{}|\\")


def rule_regex(patterns: list[str]) -> str:
    """One case-insensitive Java regex matching any of ``patterns`` anywhere."""
    return "(?i)(?:" + "|".join(patterns) + ")"


def literal_of(pattern: str) -> str | None:
    """The plain text a pattern matches when it has no regex operator besides escaped
    punctuation (``\\.``, ``\\/``); None otherwise."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 < len(pattern) and not pattern[i + 1].isalnum():
                out.append(pattern[i + 1])
                i += 2
                continue
            return None
        if ch in _META:
            return None
        out.append(ch)
        i += 1
    return "".join(out)


def ascii_lower(col: Column) -> Column:
    """Lower-case ASCII letters only (what case-insensitive ASCII patterns compare).

    Pure-ASCII strings (bytes == characters) take the fast ``lower``; others map only
    A-Z so that no non-ASCII character can fold into an ASCII one."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)) \
        .otherwise(F.translate(col, _UPPER, _LOWER))


def rule_condition(lowered: Column, patterns: list[str]) -> Column:
    """Any pattern matches the ASCII-lower-cased URL: plain-text patterns as substring
    tests, the others as one regex (patterns are lower case, so no case folding)."""
    lits = [literal_of(p) for p in patterns]
    cond = None
    for lit in lits:
        if lit is not None and lit == lit.lower():
            c = lowered.contains(lit)
            cond = c if cond is None else cond | c
    rest = [p for p, lit in zip(patterns, lits) if lit is None or lit != lit.lower()]
    if rest:
        c = lowered.rlike("(?:" + "|".join(rest) + ")") if all(p == p.lower() for p in rest) \
            else lowered.rlike(rule_regex(rest))
        cond = c if cond is None else cond | c
    return cond


def category_by_url(url, rules=None) -> Column:
    """Name of the first category whose rule matches ``url``; null when none does.

    Column form; for whole tables prefer ``with_rule_category``, which lower-cases
    each URL once."""
    rules = URL_RULES if rules is None else rules
    lowered = ascii_lower(_c(url))
    expr = None
    for name, patterns in rules:
        cond = rule_condition(lowered, patterns)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def _rule_sql(lowered: str, rules) -> str:
    from tabtrail.functions.sqlexpr import sql_str
    parts = []
    for name, patterns in rules:
        lits = [literal_of(p) for p in patterns]
        conds = [f"instr({lowered}, {sql_str(lit)}) > 0"
                 for lit in lits if lit is not None and lit == lit.lower()]
        rest = [p for p, lit in zip(patterns, lits) if lit is None or lit != lit.lower()]
        if rest:
            rx = "(?:" + "|".join(rest) + ")"
            if not all(p == p.lower() for p in rest):
                rx = "(?i)" + rx
            conds.append(f"{lowered} RLIKE {sql_str(rx)}")
        parts.append(f"WHEN {' OR '.join(conds)} THEN {sql_str(name)}")
    return "CASE " + " ".join(parts) + " END"


def with_rule_category(df, url_col: str = "url", out: str = "_rule_name", rules=None):
    """Add ``out`` = ``category_by_url(url_col)``, lower-casing each URL once in its own
    projection (the rule expression is parsed once per Spark context)."""
    from tabtrail.functions.sqlexpr import cached_expr
    rules = URL_RULES if rules is None else rules
    x = df.withColumn("_lu", ascii_lower(F.col(url_col)))
    return x.withColumn(out, cached_expr(_rule_sql("_lu", rules))).drop("_lu")


def wellness_type(name) -> Column:
    """Wellness type of a category *name* (fixed map), 'unknown' otherwise."""
    m = F.create_map(*[F.lit(x) for kv in WELLNESS_TYPE_BY_NAME.items() for x in kv])
    return F.coalesce(m[_c(name)], F.lit(DEFAULT_WELLNESS_TYPE))


def is_internal_url(url) -> Column:
    """True for browser-internal and local pages, which capture never records."""
    u = _c(url)
    cond = None
    for p in INTERNAL_URL_PREFIXES:
        c = u.startswith(p)
        cond = c if cond is None else cond | c
    for p in INTERNAL_URL_PARTS:
        cond = cond | u.contains(p)
    return cond
