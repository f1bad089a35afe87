"""Canonical forms of mathematical answers: two spellings of one value get the same text.

A value is a sum of terms, each a rational number times powers of atoms.
Atoms are the primes under a root, variables, pi, e, i, functions of values, and
sums that a root or a quotient cannot take apart.  Powers of a prime keep an
exponent between 0 and 1, powers of i are reduced, products are expanded, so
equal polynomials, radicals and quotients of numbers have equal terms.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce
from math import comb, factorial, gcd, lcm

Mono = tuple[tuple[str, Fraction], ...]
Value = dict[Mono, Fraction]

ONE: Mono = ()
HALF = Fraction(1, 2)
#: Values with more terms, larger exponents or longer numbers, and longer texts, are not put into a form, nor those that take more products of terms.
MOST_TERMS, MOST_POWER, MOST_BITS, MOST_TEXT, MOST_PRODUCTS = 400, 400, 4096, 2000, 50_000


class NoForm(ValueError):
    """The text is no mathematical answer that can be put into a form."""


def number(x) -> Value:
    return {ONE: Fraction(x)} if x else {}


def atom(name: str, power: Fraction = Fraction(1)) -> Value:
    return {((name, power),): Fraction(1)}


def rational(v: Value) -> Fraction | None:
    return v.get(ONE, Fraction(0)) if not v.keys() - {ONE} else None


def text(v: Value) -> str:
    """A value as text; equal for equal values."""
    def power(name: str, e: Fraction) -> str:
        return name if e == 1 else f"{name}^({e})"

    return "+".join("*".join([str(c), *(power(*p) for p in m)]) for m, c in sorted(v.items())) or "0"


def add(a: Value, b: Value) -> Value:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, 0) + c
    return {m: c for m, c in out.items() if c}


def scaled(a: Value, k) -> Value:
    return {m: c * k for m, c in a.items()} if k else {}


def primes(n: int) -> dict[int, int]:
    """The prime factors of n; what has none under a thousand counts as one."""
    out, p = {}, 2
    while p * p <= n and p < 1000:
        while n % p == 0:
            out[p], n = out.get(p, 0) + 1, n // p
        p += 1
    return out | ({n: out.get(n, 0) + 1} if n > 1 else {})


class Field:
    """Products, quotients and powers; remembers the sums that stand for atoms."""

    def __init__(self):
        self.sums: dict[str, Value] = {}
        self.products = 0

    def mul(self, a: Value, b: Value) -> Value:
        self.products += len(a) * len(b)
        if self.products > MOST_PRODUCTS:
            raise NoForm
        out: Value = {}
        for m, c in a.items():
            for n, d in b.items():
                for k, e in (self._term(m, n, c * d) if m and n else {m or n: c * d}).items():
                    out[k] = out.get(k, 0) + e
        out = {m: c for m, c in out.items() if c}
        if len(out) > MOST_TERMS or any(max(abs(c.numerator), c.denominator).bit_length() > MOST_BITS for c in out.values()):
            raise NoForm
        return out

    def _term(self, m: Mono, n: Mono, c: Fraction) -> Value:
        powers: dict[str, Fraction] = dict(m)
        for name, e in n:
            powers[name] = powers.get(name, Fraction(0)) + e
        whole, kept = number(1), []
        for name, e in sorted(powers.items()):
            if name.isdigit():
                c, e = c * Fraction(int(name)) ** (e.numerator // e.denominator), e % 1
            elif name == "i":
                c, e = c * (-1) ** int(e % 4 // 2), e % 2
            elif name in self.sums and e >= 1:
                whole, e = self.mul(whole, self.power(self.sums[name], e.numerator // e.denominator)), e % 1
            if e:
                kept.append((name, e))
        return scaled(self.mul(whole, {tuple(kept): Fraction(1)}) if len(whole) > 1 else {tuple(kept): Fraction(1)}, c * (1 if len(whole) > 1 else whole[ONE]))

    def power(self, v: Value, e) -> Value:
        e = Fraction(e)
        if abs(e) > MOST_POWER:
            raise NoForm
        if e.denominator == 1:
            if e < 0:
                return self.over(number(1), self.power(v, -e))
            return reduce(self.mul, [v] * int(e), number(1))
        if not v:
            return {}
        if len(v) > 1:
            return self._sum_power(v, e)
        (m, c), = v.items()
        out = number(1)
        if c < 0:
            if e.denominator == 2:
                out = self.power(atom("i"), e.numerator % 4)
            elif e.denominator % 2:
                out = number((-1) ** e.numerator)
            else:
                raise NoForm
        for n, sign in ((abs(c.numerator), 1), (c.denominator, -1)):
            for p, k in primes(n).items():
                out = self.mul(out, self._prime(p, e * k * sign))
        for name, k in m:
            if k.denominator == 1 and k % 2 == 0 and not name.isdigit() and name not in ("pi", "e"):
                raise NoForm  # an even power under a root has a sign that is not known
            out = self.mul(out, self._prime(int(name), k * e) if name.isdigit() else atom(name, k * e))
        return out

    def _prime(self, p: int, e: Fraction) -> Value:
        whole = Fraction(p) ** (e.numerator // e.denominator)
        return {((str(p), e % 1),): whole} if e % 1 else number(whole)

    def _sum_power(self, v: Value, e: Fraction) -> Value:
        """A power of a sum: its content apart, the rest as an atom."""
        size = Fraction(reduce(gcd, (c.numerator for c in v.values())), reduce(lcm, (c.denominator for c in v.values())))
        rest = scaled(v, 1 / size)
        if e.denominator == 1 and rest[max(rest)] < 0:
            size, rest = -size, scaled(rest, -1)
        name = f"({text(rest)})"
        self.sums[name] = rest
        return self.mul(self.power(number(size), e), atom(name, e))

    def over(self, a: Value, b: Value) -> Value:
        if not b:
            raise NoForm
        if len(b) == 1:
            (m, c), = b.items()
            out = scaled(a, 1 / c)
            for name, e in m:
                if name in self.sums and e > 0:
                    out = self.mul(out, atom(name, -e))
                elif name == "i":
                    out = self.mul(out, scaled(atom("i"), -1))
                else:
                    out = self.mul(out, self._prime(int(name), -e) if name.isdigit() else atom(name, -e))
            return out
        # A root or i in the divisor goes by its conjugate.
        for name, e in sorted({p for m in b for p in m}):
            if e == HALF and name.isdigit() or name == "i":
                other = {m: -c if (name, e) in m else c for m, c in b.items()}
                return self.over(self.mul(a, other), self.mul(b, other))
        names = {name for v in (a, b) for m in v for name, _ in m}
        if all(e.denominator == 1 and e > 0 for v in (a, b) for m in v for _, e in m):
            if len(names) == 1:
                common = self._common(a, b)
                a, b = self._divided(a, common)[0], self._divided(b, common)[0]
            whole, left = self._divided(a, b)
            if not left:
                return whole
        lead = b[max(b, key=_rank)]
        return self.mul(scaled(a, 1 / lead), self._sum_power(scaled(b, 1 / lead), Fraction(-1))) if len(b) > 1 else self.over(a, b)

    def _divided(self, a: Value, b: Value) -> tuple[Value, Value]:
        """Quotient and remainder of polynomials, by leading terms."""
        names = sorted({name for v in (a, b) for m in v for name, _ in m})
        rank = lambda m: (sum((e for _, e in m), Fraction(0)), [dict(m).get(name, 0) for name in names])
        top = max(b, key=rank)
        whole: Value = {}
        while a:
            m = max(a, key=rank)
            powers, need = dict(m), dict(top)
            if any(powers.get(name, 0) < e for name, e in need.items()):
                return whole, a
            rest = tuple(sorted((name, e - need.get(name, 0)) for name, e in powers.items() if e != need.get(name, 0)))
            step = {rest: a[m] / b[top]}
            whole, a = add(whole, step), add(a, scaled(self.mul(step, b), -1))
        return whole, {}

    def _common(self, a: Value, b: Value) -> Value:
        """The greatest common divisor of polynomials in one variable."""
        while b:
            a, b = b, self._divided(a, b)[1]
        return scaled(a, 1 / a[max(a, key=_rank)])


    def settled(self, v: Value) -> Value:
        """The value over one divisor, reduced."""
        below: dict[str, Fraction] = {}
        for m in v:
            for name, e in m:
                if name in self.sums and e < 0 and e.denominator == 1:
                    below[name] = max(below.get(name, 0), -e)
        if not below:
            return v
        divisor = number(1)
        for name, e in below.items():
            v, divisor = self.mul(v, atom(name, e)), self.mul(divisor, self.power(self.sums[name], e))
        return self.over(v, divisor)

    def form(self, v: Value) -> str:
        return text(self.settled(v))


def _rank(m: Mono) -> tuple:
    """Monomials by degree, then by name."""
    return sum((e for _, e in m), Fraction(0)), m


FUNCTIONS = ("arcsin", "arccos", "arctan", "sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp")
#: Other spellings of the same symbols.
SPELLINGS = {
    "−": "-", "–": "-", "×": "*", "·": "*", "⋅": "*", "÷": "/", "√": "\\sqrt", "π": "\\pi", "∞": "\\infty", "∪": "\\cup", "≤": "\\le", "≥": "\\ge", "²": "^2", "³": "^3", "°": "", "½": "\\frac12", "¼": "\\frac14", "¾": "\\frac34",
    "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\leq": "\\le", "\\geq": "\\ge", "\\lvert": "|", "\\rvert": "|", "\\left": "", "\\right": "", "\\displaystyle": "",
    "^{\\circ}": "", "^\\circ": "", "\\degree": "", "\\,": " ", "\\!": "", "\\;": " ", "\\:": " ", "\\ ": " ", "\\$": "", "$": "", "{,}": ",", "\\{": "\\lbrace ", "\\}": "\\rbrace ", "\\quad": " ", "\\%": "%", "**": "^", "~": " ",
}
_SPELLING = re.compile("|".join(re.escape(k) + (r"(?![A-Za-z])" if re.fullmatch(r"\\[a-z]+", k) else "") for k in sorted(SPELLINGS, key=len, reverse=True)))
_TOKEN = re.compile(rf"\s*(?:(\d+\.\d*|\.\d+|\d+)|\\?({'|'.join(FUNCTIONS)}|sqrt|pi|infty)(?![A-Za-z])|(\\[A-Za-z]+)|([abcxyz]+(?![A-Za-z])|[A-Za-z](?![A-Za-z]))|(<=|>=|[-+*/^_!%(){{}}\[\]|,=<>]))")


def tokens(s: str) -> list[str]:
    out, at = [], 0
    s = s.rstrip()
    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m:
            raise NoForm
        digits, known, command, letters, sign = m.groups()
        out += [f"\\{known}"] if known else list(letters) if letters else [digits or command or sign]
        at = m.end()
    return out


class Parser(Field):
    """Recursive descent over the tokens of one answer; gives values, not trees."""

    def __init__(self, s: str):
        super().__init__()
        self.tokens, self.at = tokens(s), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        """The next token, if it is one of those."""
        if (t := self.peek()) and (not wanted or t in wanted):
            self.at += 1
            return t
        return ""

    def need(self, t: str) -> None:
        if not self.take(t):
            raise NoForm

    def sum(self) -> Value:
        out = self.product()
        while sign := self.take("+", "-"):
            out = add(out, scaled(self.product(), 1 if sign == "+" else -1))
        return out

    def product(self) -> Value:
        if sign := self.take("+", "-"):
            return scaled(self.product(), 1 if sign == "+" else -1)
        out = self.factor()
        while True:
            if sign := self.take("*", "/"):
                minus = -1 if self.take("-") else 1
                out = scaled((self.mul if sign == "*" else self.over)(out, self.factor()), minus)
            elif self.peek() == "\\frac" and self.tokens[self.at - 1].isdigit() and rational(out) is not None:
                out = add(out, self.factor())  # a mixed number
            elif self.peek() == "(" or re.match(r"\\(frac|sqrt|pi|d?binom|" + "|".join(FUNCTIONS) + r")\Z|[A-Za-z]|\\[a-z]+|\d", self.peek()) and self.peek() not in _RELATIONS | _CLOSING:
                if self.peek()[0].isdigit() and self.tokens[self.at - 1][0].isdigit():
                    raise NoForm
                out = self.mul(out, self.factor())
            else:
                return out

    def factor(self) -> Value:
        out = self.base()
        while True:
            if self.take("^"):
                out = self.raised(out, self.exponent())
            elif self.take("!"):
                n = rational(out)
                if n is None or n.denominator != 1 or not 0 <= n <= 200:
                    raise NoForm
                out = number(factorial(int(n)))
            elif self.take("%"):
                out = scaled(out, Fraction(1, 100))
            else:
                return out

    def exponent(self) -> Value:
        if self.take("-"):
            return scaled(self.exponent(), -1)
        out = self.base()
        return self.raised(out, self.exponent()) if self.take("^") else out

    def raised(self, v: Value, e: Value) -> Value:
        n = rational(e)
        if n is not None:
            return self.power(v, n)
        base = self.form(v)
        return atom(f"({base})^({self.form(e)})" if base != "1*e" else f"exp({self.form(e)})")

    def group(self) -> Value:
        """What stands in braces, or the next digit or symbol."""
        if self.take("{"):
            out = self.sum()
            self.need("}")
            return out
        t = self.peek()
        if t[:1].isdigit() and len(t) > 1 and t.isdigit():  # \frac12
            self.tokens[self.at] = t[1:]
            return number(int(t[0]))
        return self.base()

    def base(self) -> Value:
        t = self.take()
        if not t:
            raise NoForm
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            return number(Fraction(t))
        for opening, closing in ("()", "{}", "[]"):
            if t == opening:
                out = self.sum()
                self.need(closing)
                return out
        if t == "|":
            out = self.sum()
            self.need("|")
            n = rational(out)
            return number(abs(n)) if n is not None else atom(f"|{min(self.form(out), self.form(scaled(out, -1)))}|")
        if t.isalpha():
            if self.take("_"):
                t += "_" + self.form(self.group())
            return atom(t)
        if t == "\\frac":
            return self.over(self.group(), self.group())
        if t in ("\\binom", "\\dbinom"):
            n, k = rational(self.group()), rational(self.group())
            if None in (n, k) or (n.denominator, k.denominator) != (1, 1) or not 0 <= k <= n <= 1000:
                raise NoForm
            return number(comb(int(n), int(k)))
        if t == "\\sqrt":
            root = number(2)
            if self.take("["):
                root = self.sum()
                self.need("]")
            n = rational(root)
            if n is None or n.denominator != 1 or n < 2:
                raise NoForm
            return self.power(self.group(), 1 / n)
        if t == "\\pi":
            return atom("pi")
        if t[1:] in FUNCTIONS:
            base = f"_{self.form(self.group())}" if self.take("_") else ""
            power = self.exponent() if self.take("^") else number(1)
            of = self.factor()
            if t == "\\exp" and not base:
                return self.raised(self.raised(atom("e"), of), power)
            return self.raised(atom(f"{t[1:]}{base}({self.form(of)})"), power)
        if re.fullmatch(r"\\[a-z]+", t) and t not in _RELATIONS | _CLOSING:
            return atom(t[1:])
        raise NoForm

    # What answers are made of beside values

    def end(self) -> str:
        """An end of an interval, or a member of a tuple or set."""
        sign = self.take("+", "-")
        if self.take("\\infty"):
            return "-oo" if sign == "-" else "oo"
        self.at -= bool(sign)
        return self.form(self.sum())

    def members(self) -> list[str]:
        out = [self.end()]
        while self.take(","):
            out.append(self.end())
        return out

    def part(self) -> str:
        """A set, a tuple, an interval or a value."""
        at = self.at
        if self.take("\\lbrace"):
            if self.take("\\rbrace"):
                return "{}"
            found = self.members()
            self.need("\\rbrace")
            return "{" + ",".join(sorted(set(found))) + "}"
        if self.take("\\emptyset", "\\varnothing"):
            return "{}"
        if opening := self.take("(", "["):
            try:
                found = self.members()
                closing = self.take(")", "]")
                if closing and len(found) > 1 and self.peek() in ("", ",", "\\cup"):
                    return f"{opening}{','.join(found)}{closing}"
            except NoForm:
                pass
            self.at = at
        return self.end()

    def answer(self) -> str:
        """A value, an equation, an inequality, a list, or a union of sets."""
        out = [self.part()]
        if relation := self.take(*_RELATIONS):
            self.at = 0
            left = self.sum()
            self.take(relation)
            if relation == "=" and len(left) == 1 and re.fullmatch(r"1\*[A-Za-z](_[^*+]+)?", text(left)):
                return self.answer_from(self.at)
            gap = self.settled(add(left, scaled(self.sum(), -1)))
            if self.peek() or not gap:
                raise NoForm
            lead = gap[max(gap, key=_rank)]
            turned = {"<": ">", ">": "<", "\\le": "\\ge", "\\ge": "\\le"}.get(relation, relation) if lead < 0 else relation
            return f"{text(scaled(gap, 1 / lead))} {turned} 0"
        while self.take("\\cup"):
            out.append(self.part())
        if len(out) > 1:
            out = [" u ".join(sorted(set(out)))]
        while self.take(","):
            self.take_name()
            out.append(self.part())
        if self.peek():
            raise NoForm
        return out[0] if len(out) == 1 else "{" + ",".join(sorted(set(out))) + "}"

    def answer_from(self, at: int) -> str:
        self.tokens, self.at = self.tokens[at:], 0
        return self.answer()

    def take_name(self) -> None:
        """The ``x =`` before another solution."""
        if self.at + 1 < len(self.tokens) and self.peek().isalpha() and self.tokens[self.at + 1] == "=":
            self.at += 2


_RELATIONS = {"=", "<", ">", "\\le", "\\ge", "\\ne", "\\neq"}
_CLOSING = {"\\lbrace", "\\rbrace", "\\cup", "\\infty", "\\pm", "\\mp", "\\text", "\\mathrm", "\\emptyset", "\\varnothing"}


def math_form(s: str | None) -> str | None:
    """The canonical form of an answer in LaTeX or plain spelling; null if it is none that can be put into a form.

    Numbers become rationals (percentages hundredths, groups of thousands one
    number, a whole number before a fraction a mixed one); roots, powers,
    polynomials and quotients are simplified; ``x = v`` is v; solutions joined by
    commas, ``or`` and ``and``, and both values of ``\\pm``, are a set; tuples and
    intervals keep their order and brackets, unions of intervals do not; other
    equations and inequalities are brought to one side.  Units and text around
    the value are left out.  Words are no variables: only a, b, c, x, y and z may
    stand side by side.
    """
    if s is None or len(s) > MOST_TEXT:
        return None
    s = re.sub(r"\\(?:text|mathrm|mbox|textbf|mathbf)\s*\{\s*(or|and)\s*\}|(?<=[\d\s)}])(or|and)(?=\s)", " , ", s)
    s = re.sub(r"(?<=\S)\s*\\(?:text|mathrm|mbox)\s*\{[^{}]*\}(\^\{?[23]\}?)?", "", s)
    s = _SPELLING.sub(lambda m: SPELLINGS[m[0]], s)
    s = re.sub(r"(?<![\d.,])\d{1,3}(?:,\d{3})+(?![\d,])", lambda m: m[0].replace(",", ""), s)
    s = re.sub(r"(\d)\s+(\d+)\s*/\s*(\d+)", r"\1\\frac{\2}{\3}", s).strip().removesuffix(".")
    try:
        if "\\pm" in s:
            return "{" + ",".join(sorted({Parser(s.replace("\\pm", x)).answer() for x in "+-"})) + "}"
        return Parser(s).answer()
    except (NoForm, ArithmeticError, RecursionError):
        return None
