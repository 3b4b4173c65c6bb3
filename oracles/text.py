"""SQL snippets. Texts are built from whole numbers, so no engine's float formatting is involved."""


def dbl(x):
    return f"CAST({x} AS DOUBLE)"


def big(x):
    return f"CAST({x} AS BIGINT)"


def cents(x):
    return f"CAST({x} * 100 AS BIGINT)"


def n0(x):
    """1,234,567 from a number that may have decimals."""
    return f"format('{{:,}}', CAST(round({x}, 0) AS BIGINT))"


def brl(x):
    """R$ 1.234,56 from a sum of money."""
    whole, rest = f"{cents(x)} // 100", f"{cents(x)} % 100"
    return f"'R$ ' || replace(format('{{:,}}', {whole}), ',', '.') || ',' || lpad(CAST({rest} AS VARCHAR), 2, '0')"


def half_up(part, whole, scale):
    """part / whole * scale as a whole number, halves up; both are whole numbers."""
    return f"((2 * CAST({scale} AS HUGEINT) * ({part}) + ({whole})) // (2 * ({whole})))"


def rounded(part, whole, digits=2):
    """part / whole with the given digits, as double."""
    return f"CAST({half_up(part, whole, 10 ** digits)} AS DOUBLE) / {10 ** digits}"


def pct(part, whole, digits, point):
    """100 * part / whole with the given digits as text."""
    scaled = half_up(part, whole, 10 ** (digits + 2))
    base = 10 ** digits
    return f"CAST({scaled} // {base} AS VARCHAR) || '{point}' || lpad(CAST({scaled} % {base} AS VARCHAR), {digits}, '0')"


def folded(x):
    """What texts are compared and grouped by: case and trailing blanks don't count."""
    return f"lower(rtrim({x}, ' '))"


def quoted(value):
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"
