"""Answers computed from a query itself: percentages, roots, arithmetic, units, dates."""

from __future__ import annotations

import math
import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# What one of the first unit is in the second.
UNITS = {
    ("km", "miles"): 0.621371, ("miles", "km"): 1.60934, ("kg", "lbs"): 2.20462, ("lbs", "kg"): 0.453592, ("m", "ft"): 3.28084, ("ft", "m"): 0.3048, ("cm", "in"): 0.393701, ("in", "cm"): 2.54,
    ("l", "gal"): 0.264172, ("gal", "l"): 3.78541, ("g", "oz"): 0.035274, ("oz", "g"): 28.3495,
}
_NAMES = {"mile": "miles", "mi": "miles", "kilometers": "km", "kilometer": "km", "pounds": "lbs", "pound": "lbs", "lb": "lbs", "kilograms": "kg", "meters": "m", "meter": "m", "feet": "ft", "foot": "ft", "inches": "in", "inch": "in", "liters": "l", "gallons": "gal", "grams": "g", "ounces": "oz"}
#: Days of the year by name.
DAYS = {"christmas": (12, 25), "christmas eve": (12, 24), "new year": (1, 1), "new years": (1, 1), "new year's eve": (12, 31), "halloween": (10, 31), "valentines day": (2, 14), "valentine's day": (2, 14)}
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def number(x: float) -> str:
    """Whole numbers below 1e15 without a point, others in six significant digits."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.6g}"


class _Arithmetic:
    """+ - * / % ^ with signs and brackets; a division or remainder by nothing leaves the left side as it is."""

    def __init__(self, text: str):
        self.parts, self.at = re.findall(r"\d+\.?\d*|\.\d+|[-+*/%^()]", text), 0

    def next(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def take(self) -> str:
        self.at += 1
        return self.parts[self.at - 1]

    def sum(self) -> float:
        x = self.product()
        while self.next() in ("+", "-"):
            x = x + self.product() if self.take() == "+" else x - self.product()
        return x

    def product(self) -> float:
        x = self.power()
        while self.next() in ("*", "/", "%"):
            op, y = self.take(), self.power()
            if op == "*":
                x *= y
            elif y != 0:
                x = x / y if op == "/" else math.fmod(x, y)
        return x

    def power(self) -> float:
        x = self.sign()
        if self.next() == "^":
            self.take()
            x = x ** self.power()
        return x

    def sign(self) -> float:
        if self.next() in ("-", "+"):
            return -self.sign() if self.take() == "-" else self.sign()
        if self.next() == "(":
            self.take()
            x = self.sum()
            if self.next() != ")":
                raise ValueError("bracket")
            self.take()
            return x
        return float(self.take())


def answer(query: str | None, now: datetime) -> str | None:
    """The answer to a query, None when it asks nothing of the kind; dates and times are those of ``now``."""
    q = re.sub(r"\s+", " ", (query or "").strip().lower()).rstrip("?= ")
    if m := re.fullmatch(rf"(?:what is )?{_NUMBER} ?(?:%|percent) of {_NUMBER}", q):
        return number(float(m[1]) / 100 * float(m[2]))
    if m := re.fullmatch(rf"(?:what is )?(?:the )?(?:sqrt|square root) ?(?:of )?\(?{_NUMBER}\)?", q):
        return number(math.sqrt(float(m[1]))) if float(m[1]) >= 0 else None
    if m := re.fullmatch(rf"(?:convert )?{_NUMBER} ?°?([a-z]+) (?:to|in) °?([a-z]+)", q):
        a, b, x = _NAMES.get(m[2], m[2]), _NAMES.get(m[3], m[3]), float(m[1])
        if a[0] == "c" and b[0] == "f" and a in ("c", "celsius"):
            return number(x * 9 / 5 + 32)
        if a in ("f", "fahrenheit") and b in ("c", "celsius"):
            return number((x - 32) * 5 / 9)
        return number(x * UNITS[a, b]) if (a, b) in UNITS else None
    if m := re.fullmatch(r"(?:how many )?days until (.+)", q):
        if m[1] not in DAYS:
            return None
        month, day = DAYS[m[1]]
        at = date(now.year, month, day)
        return str(((at if at >= now.date() else date(now.year + 1, month, day)) - now.date()).days)
    if q in ("time", "what time is it", "current time"):
        return now.strftime("%H:%M")
    if q in ("date", "what is the date", "today's date", "what day is it"):
        return now.strftime("%Y-%m-%d")
    text = re.sub(r"^(?:what is|calculate|calc) ", "", q)
    if re.fullmatch(r"[\d.\s+\-*/%^()]+", text) and re.search(r"\d", text) and re.search(r"[-+*/%^]", text.lstrip("-+ ")):
        try:
            p = _Arithmetic(text)
            x = p.sum()
            return number(x) if p.at == len(p.parts) and math.isfinite(x) else None
        except (ValueError, IndexError, OverflowError, ZeroDivisionError, TypeError):
            return None
    return None


def answers(query: Column, now: datetime) -> Column:
    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: answer(x, now))

    return run(query)
