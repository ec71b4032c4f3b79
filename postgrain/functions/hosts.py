"""International host names in their ASCII form, as a column expression.

A label with characters beyond ASCII becomes ``xn--`` and its Bootstring encoding: the ASCII
characters, then for every other character, by code point and place, how far the pair (code point,
place) lies from the one before it, as a number of variable length. The expression is text, since
building it call by call takes longer than most queries take to plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_ASCII = r"r'[^\x00-\x7F]'"
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# a distance is below 2**21 * 2**8, so it has fewer digits than this, and is halved less often
_ROUNDS = "sequence(1, 12)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sign(digit: str) -> str:
    return f"substring('{_DIGITS}', int({digit}) + 1, 1)"


# Fixed values in what follows, the parameters of the encoding for host names: base 36, thresholds
# from 1 to 26, skew 38, damping 700, first bias 72, first code point 128.

# digits of the distance x.d, the least significant first; a digit below its threshold ends it
_NUMBER = f"""aggregate({_ROUNDS}, named_struct('rest', x.d, 'digits', ''), (q, k) -> {_let(
    'low', 'greatest(1L, least(26L, 36 * k - s.bias))', f'''CASE WHEN q.rest < 0 THEN q
      WHEN q.rest < low THEN named_struct('rest', -1L, 'digits', q.digits || {_sign("q.rest")})
      ELSE named_struct('rest', (q.rest - low) div (36 - low),
        'digits', q.digits || {_sign("low + (q.rest - low) % (36 - low)")}) END''')}, q -> q.digits)"""

_NEXT_BIAS = f"""aggregate({_ROUNDS}, {_let(
    'd', 'if(x.opening, x.d div 700, x.d div 2)', "named_struct('d', d + d div x.present, 'k', 0L)")},
  (b, k) -> if(b.d > 455, named_struct('d', b.d div 35, 'k', b.k + 36), b),
  b -> b.k + (36 * b.d) div (b.d + 38))"""

# `others` are sorted in the order of their insertion; `place` counts what stands before one then
_ENCODED = _let("codes", "transform(sequence(1, length(t)), n -> bigint(ascii(substring(t, n, 1))))", _let(
    "plain", f"regexp_replace(t, {_NOT_ASCII}, '')", _let(
        "others", "array_sort(filter(transform(codes, (c, i) -> named_struct('c', c, 'i', i)), x -> x.c >= 128))", _let(
            "placed", """transform(others, (x, j) -> named_struct('c', x.c,
              'place', bigint(size(filter(codes, (c, i) -> i < x.i AND c <= x.c))),
              'present', bigint(length(plain) + j)))""", f"""aggregate(
  transform(placed, (x, j) -> named_struct(
    'd', (x.c - coalesce(get(placed, j - 1).c, 128L)) * (x.present + 1)
      + x.place - coalesce(get(placed, j - 1).place + 1, 0L),
    'present', x.present + 1, 'opening', j = 0)),
  named_struct('bias', 72L, 'text', if(plain = '', '', plain || '-')),
  (s, x) -> named_struct('bias', {_NEXT_BIAS}, 'text', s.text || {_NUMBER}), s -> s.text)"""))))

_LABEL = f"if(t rlike {_NOT_ASCII}, 'xn--' || {_ENCODED}, t)"
_HOST = f"""if(h rlike {_NOT_ASCII}, array_join(transform(
  split(regexp_replace(h, '[。．｡]', '.'), '[.]', -1),
  part -> {_let("t", "regexp_extract(part, '^([^:]*)', 1)", _LABEL)} || regexp_extract(part, '(:.*)$', 1)), '.'), h)"""


def _applied(value: Column, name: str, body: str) -> Column:
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 0)


def ascii_label(label: Column) -> Column:
    """One label of a host name in ASCII."""
    return _applied(label, "t", _LABEL)


def ascii_host(host: Column) -> Column:
    """A lower-case host name (with or without a port) in ASCII; ASCII hosts stay as they are.

    Ideographic full stops separate labels as well. Characters are taken as they are: a name
    written with combining marks is not composed first.
    """
    return _applied(host, "h", _HOST)
