"""What style sheets hide: the cascade of ``display`` and ``visibility`` over a page's elements, for a screen of fixed width.

Read are rules of selectors made of tags, classes, ids and attributes, with descendant and child
combinators; ``@media`` (type, least and largest width), ``@supports`` and ``@layer`` blocks; importance, specificity
and order. A selector with anything else (pseudo-classes, siblings) matches nothing, an unknown media feature
never holds, and layers count in order of appearance.

An element's matches follow from its own names, its parent's matches, and for each part of a selector the
number of open elements that match up to that part, so a page costs its length times the rules its elements name.
"""

from __future__ import annotations

import re
from collections import defaultdict

WIDTH = 1280
# The keywords of the display property.
DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption table-column "
    "table-column-group table-header-group table-footer-group table-row-group flow flow-root list-item contents run-in ruby ruby-base ruby-text math "
    "inherit initial unset revert revert-layer".split()
)
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.DOTALL)
_MARK = re.compile(r"""\"(?:\\.|[^"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]""")
_PART = re.compile(r"""\s*(>)\s*|\s+|((?:\*|[\w-]+)?(?:[.#][\w-]+|\[[\w-]+(?:[~|^$*]?=(?:"[^"]*"|'[^']*'|[\w-]+))?\])+|\*|[\w-]+)""")
_SIMPLE = re.compile(r"""([.#])([\w-]+)|\[([\w-]+)(?:([~|^$*]?=)(?:"([^"]*)"|'([^']*)'|([\w-]+)))?\]""")
_QUERY = re.compile(r"(?:(not|only)\s+)?(?:([a-z]+)(?:\s+and\s+|\s*\Z))?((?:\([^()]*\)(?:\s+and\s+)?)*)\s*\Z")
_LENGTH = re.compile(r"(min|max)-width\s*:\s*([\d.]+)(px|r?em)\Z")


def applies(media: str) -> bool:
    """Whether a list of media queries holds for the screen."""
    queries = [q.strip() for q in media.lower().split(",")]
    return not media.strip() or any(map(_holds, queries))


def _holds(query: str) -> bool:
    m = _QUERY.match(query)
    if not m or not query:
        return False
    true = m[2] in (None, "all", "screen")
    for feature in re.findall(r"\(([^()]*)\)", m[3]):
        length = _LENGTH.match(feature.strip())
        if not length:
            return False
        width = float(length[2]) * (1 if length[3] == "px" else 16)
        true = true and (WIDTH >= width if length[1] == "min" else WIDTH <= width)
    return true != (m[1] == "not")


def declared(body: str, into: dict[str, tuple[str, bool]] | None = None) -> dict[str, tuple[str, bool]]:
    """property -> (value, important) of the last valid declarations, important ones first; ``into`` holds earlier ones."""
    found = {} if into is None else into
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        known = DISPLAYS if name == "display" else VISIBILITIES if name == "visibility" else ()
        if colon and value in known and (important or not found.get(name, ("", False))[1]):
            found[name] = (value, important)
    return found


def rules(css: str) -> list[tuple[str, dict[str, tuple[str, bool]]]]:
    """(selectors, declarations) of the rules that hold and say something of display or visibility."""
    css = _COMMENT.sub(" ", css)
    out, open_, at = [], [], 0  # open blocks: None for a group whose rules hold, False for what is skipped, else a rule

    def close(upto: int) -> None:
        block = open_.pop()
        if block:
            declared(css[at:upto], block[1])
            if block[1]:
                out.append(block)

    for m in _MARK.finditer(css):
        if m[0] == "{":
            head = css[at : m.start()].strip()
            if open_ and open_[-1] is not None:
                open_.append(False)
            elif head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                name, paren, tail = name.partition("(")
                rest = paren + tail + " " + rest if paren else rest
                open_.append(None if name.lower() in ("supports", "layer") or (name.lower() == "media" and applies(rest)) else False)
            else:
                open_.append((head, {}))
        elif m[0] == "}":
            if open_:
                close(m.start())
        elif m[0] == ";":
            if open_ and open_[-1]:
                declared(css[at : m.start()], open_[-1][1])
        else:
            continue
        at = m.end()
    while open_:
        close(len(css))
        at = len(css)
    return out


class Compound:
    """One element's part of a selector."""

    __slots__ = ("tag", "classes", "ids", "attributes", "child")

    def __init__(self, text: str, child: bool):
        bare = re.match(r"\*|[\w-]+", text)
        self.tag = bare[0].lower() if bare and bare[0] != "*" else None
        self.child = child
        self.classes, self.ids, self.attributes = [], [], []
        for sign, name, attribute, test, *values in _SIMPLE.findall(text):
            if attribute:
                self.attributes.append((attribute.lower(), test, "".join(values)))
            else:
                (self.classes if sign == "." else self.ids).append(name)

    def key(self) -> str:
        return "#" + self.ids[0] if self.ids else "." + self.classes[0] if self.classes else self.tag or "*"

    def fits(self, tag: str, attrs: dict[str, str], classes: set[str]) -> bool:
        if (self.tag and self.tag != tag) or not classes.issuperset(self.classes) or any(attrs.get("id") != i for i in self.ids):
            return False
        return all(name in attrs and _compare(attrs[name], test, value) for name, test, value in self.attributes)


def _compare(have: str, test: str, value: str) -> bool:
    if test == "~=":
        return value in have.split()
    if test == "|=":
        return have == value or have.startswith(value + "-")
    if test in ("^=", "$=", "*="):
        return bool(value) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[test](value)
    return not test or have == value


def compounds(selector: str) -> list[Compound] | None:
    """The parts of a selector, or None where it holds something that is not read."""
    out, at, child = [], 0, False
    selector = selector.strip()
    while at < len(selector):
        m = _PART.match(selector, at)
        if not m:
            return None
        if m[2]:
            if out and not (selector[at - 1].isspace() or selector[at - 1] == ">"):
                return None
            out.append(Compound(m[2], child))
            child = False
        elif m[1]:
            if not out or child:
                return None
            child = True
        at = m.end()
    return out if out and not child else None


class Cascade:
    """Follows a walk through the tree: ``enter`` tells what the rules say of an element, ``leave`` ends it."""

    def __init__(self, sheets: list[str]):
        self.selectors: list[tuple[list[Compound], tuple[int, int, int], dict[str, tuple[str, bool]]]] = []
        self.by_key: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for heads, found in (rule for css in sheets for rule in rules(css)):
            for parts in map(compounds, heads.split(",")):
                if parts:
                    weight = (sum(len(p.ids) for p in parts), sum(len(p.classes) + len(p.attributes) for p in parts), sum(p.tag is not None for p in parts))
                    for i, part in enumerate(parts):
                        self.by_key[part.key()].append((len(self.selectors), i))
                    self.selectors.append((parts, weight, found))
        self.inside: dict[tuple[int, int], int] = defaultdict(int)
        self.path: list[list[tuple[int, int]]] = [[]]

    def enter(self, tag: str, attrs: dict[str, str]) -> dict[str, str]:
        """property -> value that wins for the element, of the sheets and its own style."""
        best: dict[str, tuple] = {}
        matched: list[tuple[int, int]] = []
        if self.selectors:
            classes = set(attrs["class"].split()) if "class" in attrs else set()
            keys = [tag, "*", *("." + c for c in classes)]
            if "id" in attrs:
                keys.append("#" + attrs["id"])
            above = self.path[-1]
            for key in keys:
                for at in self.by_key.get(key, ()):
                    s, i = at
                    parts, weight, found = self.selectors[s]
                    if i and not ((s, i - 1) in above if parts[i].child else self.inside[s, i - 1]):
                        continue
                    if parts[i].fits(tag, attrs, classes):
                        matched.append(at)
                        if i == len(parts) - 1:
                            for name, (value, important) in found.items():
                                best[name] = max(best.get(name, ()), (important, 0, weight, s, value))
            for at in matched:
                self.inside[at] += 1
            self.path.append(matched)
        if "style" in attrs:
            for name, (value, important) in declared(_COMMENT.sub(" ", attrs["style"])).items():
                best[name] = max(best.get(name, ()), (important, 1, (), 0, value))
        return {name: rank[-1] for name, rank in best.items()}

    def leave(self) -> None:
        if self.selectors:
            for at in self.path.pop():
                self.inside[at] -= 1
