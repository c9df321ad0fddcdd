"""Element selectors, compiled to steps that one pass over a page's elements follows.

CSS: groups, tags, ``*``, ids, classes, attributes with every operator, structural pseudo-classes,
``:not()``, and the four combinators. Paths (``xpath:``): child and descendant steps with names, positions
and conditions on attributes. A selector with anything else in it is unknown and matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

from webcorpus.operators.elements import Element

Test = Callable[["Placed"], bool]
#: (how it hangs on the step before, test); "" is an element without a parent
Step = tuple[str, Test]

_NAME = r"-?[A-Za-z_\u0080-\uffff][\w\u0080-\uffff-]*"
_VALUE = r""""([^"]*)"|'([^']*)'|([^\s"'\]]*)"""
_PART = re.compile(
    rf"""(?P<tag>{_NAME}|\*)|\#(?P<id>[\w\u0080-\uffff-]+)|\.(?P<cls>{_NAME})"""
    rf"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>{_VALUE})\s*)?\]"""
    r"""|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*)\))?""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*")
_PATH_STEP = re.compile(rf"(//?)({_NAME}|\*)((?:\[[^\]]*\])*)")
_CONDITION = re.compile(rf"""\[\s*(?:(\d+)|(last\(\))|@([\w:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'))?|contains\(\s*@([\w:-]+)\s*,\s*(?:"([^"]*)"|'([^']*)')\s*\))\s*\]""")


class Placed:
    """An element with its place among its siblings, all and those of its tag, counted from both ends."""

    __slots__ = ("element", "parent", "before", "place", "count", "type_place", "type_count", "empty")

    def __init__(self, element: Element, parent: Placed | None, before: Placed | None):
        self.element, self.parent, self.before = element, parent, before
        self.place = self.count = self.type_place = self.type_count = 1
        self.empty = element.start == element.end


def place(elements: Sequence[Element]) -> list[Placed]:
    """Elements in document order, with their places."""
    out: list[Placed] = []
    by_el: dict[int, Placed] = {}
    families: dict[int | None, list[Placed]] = {}
    for element in elements:
        parent = by_el[element.up.el] if element.up is not None else None
        family = families.setdefault(element.parent, [])
        placed = Placed(element, parent, family[-1] if family else None)
        family.append(placed)
        by_el[element.el] = placed
        out.append(placed)
        if parent is not None:
            parent.empty = False
    for family in families.values():
        types: dict[str, list[Placed]] = {}
        for number, placed in enumerate(family, 1):
            placed.place, placed.count = number, len(family)
            types.setdefault(placed.element.tag, []).append(placed)
        for same in types.values():
            for number, placed in enumerate(same, 1):
                placed.type_place, placed.type_count = number, len(same)
    return out


def _nth(argument: str | None) -> Callable[[int], bool] | None:
    """``an+b``, ``odd``, ``even`` or a number."""
    met = _NTH.fullmatch(argument or "")
    if met is None:
        return None
    if met[1]:
        step, first = 2, int(met[1] == "odd")
    elif met[5]:
        step, first = 0, int(met[5])
    else:
        step = int(met[2] + "1") if met[2] in ("", "+", "-") else int(met[2])
        first = int((met[3] or "+") + (met[4] or "0"))
    return lambda n: n == first if step == 0 else (n - first) % step == 0 and (n - first) // step >= 0


def _attribute(name: str, op: str | None, value: str) -> Test:
    name = name.lower()

    def held(p: Placed) -> str | None:
        return p.element.attrs.get(name)

    if op is None:
        return lambda p: held(p) is not None
    if op == "=":
        return lambda p: held(p) == value
    if op == "~=":
        return lambda p: value in (held(p) or "").split()
    if op == "|=":
        return lambda p: held(p) == value or (held(p) or "").startswith(value + "-")
    kind = {"^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}[op]
    return lambda p: bool(value) and kind(held(p) or "", value)


_STRUCTURE: dict[str, Test] = {
    "first-child": lambda p: p.place == 1, "last-child": lambda p: p.place == p.count, "only-child": lambda p: p.count == 1,
    "first-of-type": lambda p: p.type_place == 1, "last-of-type": lambda p: p.type_place == p.type_count,
    "only-of-type": lambda p: p.type_count == 1, "empty": lambda p: p.empty, "root": lambda p: p.parent is None,
}
_COUNTED: dict[str, Callable[[Placed], int]] = {
    "nth-child": lambda p: p.place, "nth-last-child": lambda p: p.count + 1 - p.place,
    "nth-of-type": lambda p: p.type_place, "nth-last-of-type": lambda p: p.type_count + 1 - p.type_place,
}


def _pseudo(name: str, argument: str | None) -> Test | None:
    if argument is None:
        return _STRUCTURE.get(name)
    if name in _COUNTED:
        wanted, number = _nth(argument), _COUNTED[name]
        return wanted and (lambda p: wanted(number(p)))
    if name == "not":
        inner = [_compound(part.strip()) for part in argument.split(",")]
        return None if None in inner else lambda p: not any(test(p) for test in inner)
    return None


def _compound(text: str) -> Test | None:
    """A tag or ``*`` with ids, classes, attributes and pseudo-classes."""
    tests: list[Test] = []
    at = 0
    while at < len(text):
        part = _PART.match(text, at)
        if part is None or part["tag"] and at:
            return None
        at = part.end()
        if part["tag"]:
            tag = part["tag"].lower()
            if tag != "*":
                tests.append(lambda p, tag=tag: p.element.tag == tag)
        elif part["id"]:
            tests.append(lambda p, name=part["id"]: p.element.el_id == name)
        elif part["cls"]:
            tests.append(lambda p, name=part["cls"]: name in p.element.classes)
        elif part["attr"]:
            value = (part["val"] or "").strip()
            tests.append(_attribute(part["attr"], part["op"], value[1:-1] if value[:1] in ("'", '"') else value))
        else:
            test = _pseudo(part["pseudo"], part["arg"])
            if test is None:
                return None
            tests.append(test)
    return (lambda p: all(test(p) for test in tests)) if text else None


def _css(group: str) -> list[Step] | None:
    steps: list[Step] = []
    hangs, at, start, depth = " ", 0, 0, 0
    group = group.strip()
    while at <= len(group):
        if at < len(group):
            depth += (group[at] in "[(") - (group[at] in "])")
        met = _COMBINATOR.match(group, at) if depth == 0 and at < len(group) else None
        if met or at == len(group):
            test = _compound(group[start:at])
            if test is None:
                return None
            steps.append((hangs if steps else " ", test))
            if met is None:
                return steps
            hangs, start = met[1] or " ", met.end()
            at = start
            if at == len(group):
                return None
        else:
            at += 1
    return None


def _conditions(text: str, tag: str) -> list[Test] | None:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        met = _CONDITION.match(text, at)
        if met is None:
            return None
        at = met.end()
        if met[1] or met[2]:
            if tests:
                return None  # a position after a condition counts what the condition leaves
            number = _COUNTED["nth-child" if tag == "*" else "nth-of-type"]
            from_end = _COUNTED["nth-last-child" if tag == "*" else "nth-last-of-type"]
            tests.append((lambda p, n=int(met[1]): number(p) == n) if met[1] else (lambda p: from_end(p) == 1))
        elif met[3]:
            value = met[4] if met[4] is not None else met[5]
            tests.append(_attribute(met[3], None if value is None else "=", value or ""))
        else:
            part = met[7] if met[7] is not None else met[8]
            tests.append(lambda p, name=met[6].lower(), part=part: name in p.element.attrs and part in p.element.attrs[name])
    return tests


def _path(text: str) -> list[Step] | None:
    steps: list[Step] = []
    text = text.strip().removeprefix(".")
    at = 0
    while at < len(text):
        met = _PATH_STEP.match(text, at)
        if met is None:
            return None
        at = met.end()
        tag = met[2].lower()
        more = _conditions(met[3], tag)
        if more is None:
            return None
        tests = [lambda p, tag=tag: tag in ("*", p.element.tag), *more]
        hangs = " " if met[1] == "//" else ">" if steps else ""
        steps.append((hangs, lambda p, tests=tests: all(test(p) for test in tests)))
    return steps or None


def _split(selector: str) -> list[str]:
    """The groups of a selector: commas outside brackets part them."""
    groups, depth = [""], 0
    for sign in selector:
        depth += (sign in "[(") - (sign in "])")
        if sign == "," and depth == 0:
            groups.append("")
        else:
            groups[-1] += sign
    return groups


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The steps of each group that is known."""
    found = [_path(selector.removeprefix("xpath:"))] if selector.startswith("xpath:") else [_css(group) for group in _split(selector)]
    return tuple(tuple(steps) for steps in found if steps)


def first_match(selector: str, elements: Sequence[Placed]) -> Element | None:
    """The first element of the page that a selector fits.

    Every element gets the set of steps that end at it, as bits: what holds at its parent, above it, at
    the sibling before it and at earlier siblings says which steps may begin.
    """
    first = None
    for steps in compiled(selector):
        last = 1 << (len(steps) - 1)
        own: dict[int, tuple[int, int, int]] = {}  # here, here or above, here or at an earlier sibling
        for p in elements:
            if first is not None and p.element.el >= first.el:
                break
            here_p, above_p, _ = own[p.parent.element.el] if p.parent else (0, 0, 0)
            here_b, _, earlier_b = own[p.before.element.el] if p.before else (0, 0, 0)
            held = {">": here_p, " ": above_p, "+": here_b, "~": earlier_b, "": 0}
            here = 0
            for number, (hangs, test) in enumerate(steps):
                begins = (hangs != "" or p.parent is None) if number == 0 else held[hangs] >> (number - 1) & 1
                if begins and test(p):
                    here |= 1 << number
            if here & last:
                first = p.element
                break
            own[p.element.el] = here, here | above_p, here | earlier_b
    return first
