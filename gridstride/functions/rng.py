"""Seeded random draws (G07) and string hashing as native column expressions, in 64-bit integers with 32-bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _mul(a: str, b: int) -> str:
    """A 32-bit product, by halves so that it stays within 64 bits."""
    return f"(((({a}) & 65535) * {b}L + ((shiftrightunsigned({a}, 16) * {b & 0xFFFF}L) & 65535) * 65536L) & {MASK}L)"


def draws(seed: str, count: int) -> Column:
    """The first ``count`` draws of the small fast counter generator seeded by a column."""
    # seeding: a 32-bit mixer gives four words
    words = []
    for k in range(1, 5):
        a = f"(({seed} + {k * 0x9E3779B9 & MASK}L) & {MASK}L)"
        t = _mul(f"{a} ^ shiftrightunsigned({a}, 16)", 0x21F0AAAD)
        t = f"transform(array({t}), t -> t ^ shiftrightunsigned(t, 15))[0]"
        t = f"transform(array({t}), t -> {_mul('t', 0x735A2D97)})[0]"
        words.append(f"transform(array({t}), t -> t ^ shiftrightunsigned(t, 15))[0]")
    start = f"named_struct('a', {words[0]}, 'b', {words[1]}, 'c', {words[2]}, 'd', {words[3]}, 'out', cast(array() as array<double>))"
    t = f"((s.a + s.b + s.d) & {MASK}L)"
    step = f"""named_struct('a', s.b ^ shiftrightunsigned(s.b, 9), 'b', (s.c + s.c * 8) & {MASK}L, 'c', (((shiftleft(s.c, 21) | shiftrightunsigned(s.c, 11)) & {MASK}L) + {t}) & {MASK}L, 'd', (s.d + 1) & {MASK}L,
        'out', if(k > 12, concat(s.out, array({t} / 4294967296D)), s.out))"""
    return F.expr(f"aggregate(sequence(1, {12 + count}), {start}, (s, k) -> {step}).out")


def fnv1a(text: str) -> Column:
    """A 32-bit hash of the text's characters (of the basic plane)."""
    return F.expr(f"aggregate(split({text}, ''), 2166136261L, (h, c) -> if(c = '', h, {_mul('(h ^ ascii(c))', 0x01000193)}))")
