"""Substructure patterns, rings, and fingerprints whose bits are questions about a molecule."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

NUMBERS = {"H": 1, "Li": 3, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Mg": 12, "Al": 13, "Si": 14, "P": 15, "S": 16, "Cl": 17, "K": 19, "Ca": 20, "Fe": 26, "Cu": 29, "Zn": 30, "As": 33, "Se": 34, "Br": 35, "I": 53}
_ATOM = re.compile(r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]|Br|Cl|[BCNOPSFIbcnops*aA]")
_PART = re.compile(r"\$\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|#\d+|[DXxRrvHh]\d*|[+-]+\d*|@+|:\d+|\d+|[A-Z][a-z]?|[a-z]|\*|!|,|;|&")
_BONDS = "-=#:~@!/\\,&;"


def rings_of(m) -> list[list[int]]:
    """A smallest set of smallest rings, each as its atoms in order around the ring."""
    edges = sorted((i, j) for i in range(len(m)) for j in m.bonds[i] if i < j)
    index = {e: k for k, e in enumerate(edges)}
    need = len(edges) - len(m) + len(m.components())
    found: dict[frozenset, list[int]] = {}
    for a, b in edges if need else []:
        # Shortest way round without this bond, and the shortest through each neighbour, so that fused rings are seen.
        for first in (None, *[j for j in m.bonds[a] if j != b]):
            start = a if first is None else first
            before, layer = {a: a, start: a}, [start]
            while layer and b not in before:
                following = []
                for i in layer:
                    for j in m.bonds[i]:
                        if j not in before and not (i == a and j == b):
                            before[j] = i
                            following.append(j)
                layer = following
            if b in before:
                ring, i = [b], b
                while i != a:
                    i = before[i]
                    ring.append(i)
                found.setdefault(frozenset(ring), ring)
    basis: dict[int, int] = {}
    out = []
    for ring in sorted(found.values(), key=lambda r: (len(r), sorted(r))):
        row = 0
        for k in range(len(ring)):
            row ^= 1 << index[tuple(sorted((ring[k - 1], ring[k])))]
        while row and row.bit_length() in basis:
            row ^= basis[row.bit_length()]
        if row:
            basis[row.bit_length()] = row
            out.append(ring)
        if len(out) == need:
            break
    return out


class View:
    """What patterns ask of a molecule, computed once."""

    def __init__(self, m):
        self.m, self.rings = m, rings_of(m)
        self.sizes: list[list[int]] = [[] for _ in range(len(m))]
        self.ring_bonds = set()
        for r in self.rings:
            for k, i in enumerate(r):
                self.sizes[i].append(len(r))
                self.ring_bonds.add(frozenset((r[k - 1], i)))
        plain = [sum(m.elements[j] == "H" for j in m.bonds[i]) for i in range(len(m))]
        self.hydrogens = [m.hydrogens[i] + plain[i] for i in range(len(m))]


Test = Callable[[View, int], bool]


def _primitive(text: str) -> Test:
    kind, number = text[0], re.search(r"\d+$", text)
    n = int(number[0]) if number else None
    if text == "*":
        return lambda v, i: True
    if text == "a":
        return lambda v, i: v.m.aromatic[i]
    if text == "A":
        return lambda v, i: not v.m.aromatic[i]
    if text.startswith("$("):
        inner = compile_pattern(text[2:-1])
        return lambda v, i: any(True for _ in inner.at(v, i))
    if kind == "#":
        return lambda v, i: NUMBERS.get(v.m.elements[i]) == n
    if kind in "+-":
        charge = (1 if kind == "+" else -1) * (n if n is not None else len(text))
        return lambda v, i: v.m.charges[i] == charge
    if kind in "@:" or text.isdigit():
        return lambda v, i: True
    if re.fullmatch(r"[DXxRrvHh]\d*", text) and not (text in ("H",) and False):
        want = 1 if n is None else n
        return {
            "D": lambda v, i: len(v.m.bonds[i]) == want,
            "X": lambda v, i: len(v.m.bonds[i]) + v.m.hydrogens[i] == want,
            "H": lambda v, i: v.hydrogens[i] == want,
            "h": lambda v, i: v.m.hydrogens[i] == want,
            "v": lambda v, i: int(sum(v.m.bonds[i].values()) + v.m.hydrogens[i]) == want,
            "R": lambda v, i: bool(v.sizes[i]) if n is None else len(v.sizes[i]) == n,
            "r": lambda v, i: bool(v.sizes[i]) if n is None else n in v.sizes[i],
            "x": lambda v, i: sum(frozenset((i, j)) in v.ring_bonds for j in v.m.bonds[i]) == want if n is not None else bool(v.sizes[i]),
        }[kind]
    name, low = text.capitalize(), text[0].islower()
    return lambda v, i: v.m.elements[i] == name and v.m.aromatic[i] == low


def _atom(text: str) -> Test:
    if text[0] != "[":
        return _primitive(text)
    body = re.sub(r"^\d+", "", text[1:-1])
    parts = _PART.findall(body)
    if "".join(parts) != body:
        raise ValueError(f"cannot read {text}")
    if parts == ["H"]:
        return lambda v, i: v.m.elements[i] == "H"

    def all_of(items: list[str]) -> Test:
        tests, negated = [], False
        for p in items:
            if p == "!":
                negated = not negated
            elif p != "&":
                one = _primitive(p)
                tests.append((lambda v, i, one=one: not one(v, i)) if negated else one)
                negated = False
        return lambda v, i: all(t(v, i) for t in tests)

    def split(items: list[str], mark: str) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for p in items:
            out[-1].append(p) if p != mark else out.append([])
        return out

    groups = [[all_of(x) for x in split(g, ",")] for g in split(parts, ";")]
    return lambda v, i: all(any(t(v, i) for t in g) for g in groups)


def _bond(text: str) -> Callable[[View, int, int], bool]:
    def single(p: str):
        return {
            "": lambda o, r: o in (1, 1.5), "-": lambda o, r: o == 1, "/": lambda o, r: o == 1, "\\": lambda o, r: o == 1, "=": lambda o, r: o == 2, "#": lambda o, r: o == 3,
            ":": lambda o, r: o == 1.5, "~": lambda o, r: True, "@": lambda o, r: r,
        }[p]

    groups = []
    for group in text.split(";"):
        choices = []
        for choice in group.split(","):
            tests, negated = [], False
            for p in choice or [""]:
                if p == "!":
                    negated = True
                elif p != "&":
                    tests.append((single(p), negated))
                    negated = False
            choices.append(tests)
        groups.append(choices)

    def test(v: View, a: int, b: int) -> bool:
        o, r = v.m.bonds[a][b], frozenset((a, b)) in v.ring_bonds
        return all(any(all(t(o, r) != negated for t, negated in tests) for tests in choices) for choices in groups)

    return test


class Pattern:
    """Atoms and bonds to be found, in the order of the text; `at` yields the places where the first atom is given."""

    def __init__(self, text: str):
        self.atoms: list[Test] = []
        self.links: list[list[tuple[int, Callable]]] = []
        stack, rings, last, mark, i = [], {}, None, "", 0
        while i < len(text):
            c = text[i]
            if c == "(":
                stack.append(last)
            elif c == ")":
                last = stack.pop()
            elif c == ".":
                last = None
            elif c.isdigit() or c == "%":
                key = text[i + 1 : i + 3] if c == "%" else c
                i += 2 if c == "%" else 0
                if key in rings:
                    other, kind = rings.pop(key)
                    self.links[last].append((other, _bond(mark or kind)))
                else:
                    rings[key] = (last, mark)
                mark = ""
            elif c in _BONDS:
                mark += c
            else:
                found = _ATOM.match(text, i)
                if not found:
                    raise ValueError(f"cannot read {text} at {i}")
                self.atoms.append(_atom(found[0]))
                self.links.append([] if last is None else [(last, _bond(mark))])
                last, mark = len(self.atoms) - 1, ""
                i = found.end() - 1
            i += 1
        if stack or rings or not self.atoms:
            raise ValueError(f"cannot read {text}")

    def at(self, v: View, first: int | None = None):
        chosen: list[int] = []

        def extend(k: int):
            if k == len(self.atoms):
                yield tuple(chosen)
                return
            ties = self.links[k]
            pool = v.m.bonds[chosen[ties[0][0]]] if ties else range(len(v.m)) if k or first is None else (first,)
            for i in pool:
                if i not in chosen and self.atoms[k](v, i) and all(chosen[o] in v.m.bonds[i] and bond(v, chosen[o], i) for o, bond in ties):
                    chosen.append(i)
                    yield from extend(k + 1)
                    chosen.pop()

        yield from extend(0)

    def count(self, v: View, least: int = 1) -> int:
        """Matches with different sets of atoms, counted up to `least`."""
        seen = set()
        for match in self.at(v):
            seen.add(frozenset(match))
            if len(seen) >= least:
                break
        return len(seen)


@lru_cache(maxsize=4096)
def compile_pattern(text: str) -> Pattern:
    return Pattern(text)


def read_keys(path: str) -> tuple[tuple[int, str, int], ...]:
    """(bit, pattern, least number of matches) from a file with tabs; lines that begin with # are left out."""
    out = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if line.strip() and not line.startswith("# "):
                bit, pattern, *least = line.rstrip("\n").split("\t")
                compile_pattern(pattern)
                out.append((int(bit), pattern, int(least[0]) if least and least[0] else 1))
    return tuple(out)


def key_bits(m, keys: Sequence[tuple[int, str, int]], v: View | None = None) -> list[int]:
    v = v or View(m)
    return sorted(bit for bit, pattern, least in keys if compile_pattern(pattern).count(v, least) >= least)


#: Fixed values of the published fingerprint of 881 bits: numbers of atoms asked for, from bit 0 on.
ELEMENT_STEPS = (
    ("H", (4, 8, 16, 32)), ("Li", (1, 2)), ("B", (1, 2, 4)), ("C", (2, 4, 8, 16, 32)), ("N", (1, 2, 4, 8)), ("O", (1, 2, 4, 8, 16)), ("F", (1, 2, 4)), ("Na", (1, 2)), ("Si", (1, 2)),
    ("P", (1, 2, 4)), ("S", (1, 2, 4, 8)), ("Cl", (1, 2, 4, 8)), ("K", (1, 2)), ("Br", (1, 2, 4)), ("I", (1, 2, 4)),
)
#: Elements asked for once each, from bit 49 on.
SINGLE_ELEMENTS = (
    "Be Mg Al Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Kr Rb Sr Y Zr Nb Mo Ru Rh Pd Ag Cd In Sn Sb Te Xe Cs Ba Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Tc U"
).split()
#: Sizes of rings and how many of each are asked for, seven bits a step, from bit 115 on.
RING_STEPS = ((3, 2), (4, 2), (5, 5), (6, 5), (7, 2), (8, 2), (9, 1), (10, 1))
#: Bonded pairs of elements, from bit 263 on.
PAIRS = (
    "Li-H Li-Li Li-B Li-C Li-O Li-F Li-P Li-S Li-Cl B-H B-B B-C B-N B-O B-F B-Si B-P B-S B-Cl B-Br C-H C-C C-N C-O C-F C-Na C-Mg C-Al C-Si C-P C-S C-Cl C-As C-Se C-Br C-I N-H N-N N-O N-F N-Si N-P N-S "
    "N-Cl N-Br O-H O-O O-Mg O-Na O-Al O-Si O-P O-K F-P F-S Al-H Al-Cl Si-H Si-Si Si-Cl P-H P-P As-H As-As"
).split()


def pubchem_bits(m, keys: Sequence[tuple[int, str, int]] = ()) -> list[int]:
    """Bits of counts of elements, of rings and of bonded pairs by rule; those of patterns (from 327 on) by a table of keys."""
    v = View(m)
    count = Counter(m.elements)
    count["H"] += sum(m.hydrogens)
    out, bit = [], 0
    for element, steps in ELEMENT_STEPS:
        out += [bit + k for k, least in enumerate(steps) if count[element] >= least]
        bit += len(steps)
    out += [bit + k for k, element in enumerate(SINGLE_ELEMENTS) if count[element]]
    bit += len(SINGLE_ELEMENTS)
    kinds = []
    for r in v.rings:
        aromatic = all(m.aromatic[i] for i in r)
        saturated = all(m.bonds[r[k - 1]][r[k]] == 1 for k in range(len(r)))
        others = {m.elements[i] for i in r} - {"C"}
        kinds.append((len(r), aromatic, aromatic or saturated, not others, "N" in others, bool(others)))
    for size, most in RING_STEPS:
        of = [k for k in kinds if k[0] == size]
        numbers = [len(of), *(sum(k[2] == sound and k[part] for k in of) for sound in (True, False) for part in (3, 4, 5))]
        for least in range(1, most + 1):
            out += [bit + k for k, n in enumerate(numbers) if n >= least]
            bit += 7
    aromatic, mixed = sum(k[1] for k in kinds), sum(k[1] and k[5] for k in kinds)
    for least in range(1, 5):
        out += [bit + k for k, n in enumerate((aromatic, mixed)) if n >= least]
        bit += 2
    pairs = {frozenset((m.elements[i], m.elements[j])) for i in range(len(m)) for j in m.bonds[i]}
    pairs |= {frozenset((m.elements[i], "H")) for i in range(len(m)) if m.hydrogens[i]}
    out += [bit + k for k, p in enumerate(PAIRS) if frozenset(p.split("-")) in pairs]
    return sorted({*out, *key_bits(m, keys, v)})
