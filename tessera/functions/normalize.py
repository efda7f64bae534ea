"""Normal forms of declared text, as SQL expressions for Spark; ``dialect`` spells the same for another engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of types.
TYPE_ALIASES = {
    "int": "integer", "int4": "integer", "int2": "smallint", "int8": "bigint", "float": "double precision", "float8": "double precision", "float4": "real", "serial": "integer", "bigserial": "bigint", "bool": "boolean",
    "character varying": "varchar", "character": "char", "decimal": "numeric", "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone", "time": "time without time zone", "timetz": "time with time zone",
}
_WORD = r'"?[a-zA-Z_][a-zA-Z0-9_]*"?'
#: A cast: a type's name, which may be qualified or of several words, with parameters, as an array or not.
CAST = rf"::\s*{_WORD}(\.{_WORD})?( varying| precision)?(\([0-9, ]*\))?( with(out)? time zone)?(\[\])*"
#: Functions that stand for the present time.
NOW = ("now()", "current_timestamp", "current_timestamp()", "localtimestamp", "localtimestamp()", "transaction_timestamp()", "statement_timestamp()", "clock_timestamp()")


def _all(x: str, pattern: str, by: str, dialect: str) -> str:
    """Replaces all matches."""
    if dialect == "spark":
        return f"regexp_replace({x}, r'{pattern}', r'{by}')"
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _first(x: str, pattern: str, dialect: str) -> str:
    return f"regexp_extract({x}, {'r' if dialect == 'spark' else ''}'{pattern}', 1)"


def type_sql(x: str, dialect: str = "spark") -> str:
    """Lower case, one name for each type, parameters without spaces behind it."""
    t = f"lower(trim({_all(x, r'\s+', ' ', dialect)}))"
    array = f"CASE WHEN {t} LIKE '%[]' THEN '[]' ELSE '' END"
    plain = _all(t, r"\[\]", "", dialect)
    params = _all(_first(plain, r"(\([0-9, ]*\))", dialect), " ", "", dialect)
    base = f"trim({_all(_all(plain, r'\([0-9, ]*\)', ' ', dialect), r'\s+', ' ', dialect)})"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_ALIASES.items())
    return f"concat(CASE {base} {cases} ELSE {base} END, {params}, {array})"


def _number(x: str, pattern: str, dialect: str) -> str:
    return f"{'try_cast' if dialect == 'spark' else 'TRY_CAST'}({_first(x, pattern, dialect)} AS INT)"


def widens_sql(old: str, new: str, dialect: str = "spark") -> str:
    """Whether a change between normal types counts as widening: longer text, larger integers, a number with no fewer digits
    in all and behind the point (of which a larger scale may leave fewer before it, as in the rule that this follows)."""
    length = lambda x: _number(x, r"^(?:varchar|char)\(([0-9]+)\)$", dialect)
    precision = lambda x: _number(x, r"^numeric\(([0-9]+)", dialect)
    scale = lambda x: f"coalesce({_number(x, r'^numeric\([0-9]+,([0-9]+)\)$', dialect)}, 0)"
    return (
        f"(({old} = 'smallint' AND {new} IN ('integer', 'bigint')) OR ({old} = 'integer' AND {new} = 'bigint')"
        f" OR coalesce({length(new)} >= {length(old)} AND substr({old}, 1, 4) = substr({new}, 1, 4), FALSE)"
        f" OR coalesce({precision(new)} >= {precision(old)} AND {scale(new)} >= {scale(old)}, FALSE))"
    )


def default_sql(x: str, dialect: str = "spark") -> str:
    """Without casts; one name for the present time; booleans as one letter."""
    plain = f"trim({_all(x, CAST, '', dialect)})"
    times = ", ".join(f"'{n}'" for n in NOW)
    return f"CASE WHEN lower({plain}) IN ({times}) THEN 'current_timestamp' WHEN lower({plain}) IN ('true', '''t''') THEN 't' WHEN lower({plain}) IN ('false', '''f''') THEN 'f' ELSE {plain} END"


def comment_sql(x: str, dialect: str = "spark") -> str:
    """Line feeds go, runs of spaces become one, an empty comment is none."""
    lines = _all(f"coalesce({x}, '')", r"[\r\n]+", "", dialect)
    return f"nullif(trim({_all(lines, ' +', ' ', dialect)}), '')"


def identifier_sql(x: str, dialect: str = "spark") -> str:
    """Unquoted, lower case, cut to the length that names may have."""
    return f"substr(lower({_all(f'trim({x})', chr(34), '', dialect)}), 1, 63)"


def action_sql(x: str, dialect: str = "spark") -> str:
    return f"coalesce(nullif(upper(trim({x})), ''), 'NO ACTION')"


def check_option_sql(x: str, dialect: str = "spark") -> str:
    return f"nullif(nullif(upper(trim({x})), ''), 'NONE')"


def interval_sql(x: str, dialect: str = "spark") -> str:
    """Hours, minutes and seconds as a clock time; days and longer as words in the singular."""
    t = f"lower(trim({_all(x, r'\s+', ' ', dialect)}))"
    n = f"coalesce({_number(t, r'^([0-9]+) (?:hour|hours|minute|minutes|min|mins|second|seconds|sec|secs)$', dialect)}, 0)"
    pad = lambda v: f"lpad(cast({v} AS {'string' if dialect == 'spark' else 'VARCHAR'}), 2, '0')"
    div = (lambda a, b: f"({a} div {b})") if dialect == "spark" else (lambda a, b: f"({a} // {b})")
    seconds = f"({n} * CASE WHEN {t} LIKE '% hour%' THEN 3600 WHEN {t} LIKE '% min%' THEN 60 ELSE 1 END)"
    clock = f"concat({pad(div(seconds, 3600))}, ':', {pad(f'({div(seconds, 60)} % 60)')}, ':', {pad(f'({seconds} % 60)')})"
    words = _all(t, r"(day|week|month|year|mon)s( |$)", r"$1$2" if dialect == "spark" else r"\1\2", dialect)
    is_clock = f"{t} LIKE '% hour%' OR {t} LIKE '% min%' OR {t} LIKE '% sec%'"
    return f"CASE WHEN ({is_clock}) AND {n} > 0 THEN {clock} ELSE {words} END"


def seconds_sql(x: str, dialect: str = "spark") -> str:
    """Length of an interval, all of its units and its clock time added up, months as 30 days: for comparing which of two is
    shorter."""
    t = f"lower(trim({x}))"
    units = {r"([0-9]+) *y(?:ea)?rs?": 31536000, r"([0-9]+) *mon(?:th)?s?": 2592000, r"([0-9]+) *weeks?": 604800, r"([0-9]+) *days?": 86400, r"([0-9]+) *h(?:ou)?rs?": 3600, r"([0-9]+) *min(?:ute)?s?": 60, r"([0-9]+) *sec(?:ond)?s?": 1}
    units |= {r"([0-9]+):[0-9]+": 3600, r"[0-9]+:([0-9]+)": 60, r"[0-9]+:[0-9]+:([0-9]+)": 1, r"^([0-9]+)$": 1}
    return "(" + " + ".join(f"coalesce({_number(t, pattern, dialect)}, 0) * {size}" for pattern, size in units.items()) + ")"


def body_sql(x: str, dialect: str = "spark") -> str:
    return f"lower(trim({_all(f'coalesce({x}, {chr(39) * 2})', r'\s+', ' ', dialect)}))"


def column(sql: str) -> Column:
    return F.expr(sql)
