"""Structures: parsing, standardising, scaffolds and fingerprints, in Arrow batches.

The built-in backend is a small reader of the line notation; its fingerprints follow the published ideas (circular
environments, linear paths) with hashes of its own, so bits differ from those of any other program. Kinds that need a
full chemistry toolkit are served by one registered with `register` and otherwise raise `MissingBackend`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from lodewright.functions import patterns


class MissingBackend(RuntimeError):
    """A feature kind that the built-in backend does not compute."""


TOKEN = re.compile(r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|%\d\d|[0-9()=#:\-/\\.$~]")
BRACKET = re.compile(r"^\[(\d+)?([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2})(?:H(\d*))?([+-]+\d*|)(?::\d+)?\]$")
ORDER = {"-": 1, "=": 2, "#": 3, ":": 1.5, "$": 4, "/": 1, "\\": 1, "~": 1}
#: Usual valences and atomic masses: fixed values.
VALENCE = {"B": 3, "C": 4, "N": 3, "O": 2, "P": 3, "S": 2, "F": 1, "Cl": 1, "Br": 1, "I": 1}
MASS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Br": 79.904, "I": 126.904}


@dataclass
class Molecule:
    elements: list[str] = field(default_factory=list)
    aromatic: list[bool] = field(default_factory=list)
    charges: list[int] = field(default_factory=list)
    hydrogens: list[int] = field(default_factory=list)
    bonds: list[dict[int, float]] = field(default_factory=list)
    #: The line it was read from: its tokens, the place of each atom's token and of the bond mark before it (or -1), and
    #: the atom each was attached to (or -1).
    tokens: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.elements)

    def components(self) -> list[list[int]]:
        seen, out = set(), []
        for start in range(len(self)):
            if start not in seen:
                stack, part = [start], []
                seen.add(start)
                while stack:
                    i = stack.pop()
                    part.append(i)
                    for j in self.bonds[i]:
                        if j not in seen:
                            seen.add(j)
                            stack.append(j)
                out.append(sorted(part))
        return out

    def core(self) -> set[int]:
        """Rings and what links them: atoms left when ends are pruned again and again."""
        left = set(range(len(self)))
        degree = {i: len(self.bonds[i]) for i in left}
        ends = [i for i in left if degree[i] <= 1]
        while ends:
            i = ends.pop()
            if i in left:
                left.discard(i)
                for j in self.bonds[i]:
                    if j in left:
                        degree[j] -= 1
                        if degree[j] <= 1:
                            ends.append(j)
        return left

    def n_rings(self) -> int:
        return sum(map(len, self.bonds)) // 2 - len(self) + len(self.components())


def parse(text: str | None) -> Molecule | None:
    """The molecule of a line, or None if it cannot be read."""
    if not text:
        return None
    tokens = TOKEN.findall(text)
    if "".join(tokens) != text:
        return None
    m, stack, rings, last, order, mark = Molecule(tokens=tokens), [], {}, None, None, -1
    for at, t in enumerate(tokens):
        if t == "(":
            stack.append(last)
        elif t == ")":
            if not stack:
                return None
            last = stack.pop()
        elif t == ".":
            last, order, mark = None, None, -1
        elif t in ORDER:
            order, mark = t, at
        elif t[0] == "%" or t.isdigit():
            if last is None:
                return None
            if t in rings:
                other, kind = rings.pop(t)
                if other == last or other in m.bonds[last]:
                    return None
                value = ORDER[order or kind] if order or kind else (1.5 if m.aromatic[last] and m.aromatic[other] else 1)
                m.bonds[last][other] = m.bonds[other][last] = value
            else:
                rings[t] = (last, order)
            order, mark = None, -1
        else:
            charge, hs = 0, None
            if t[0] == "[":
                b = BRACKET.match(t)
                if not b:
                    return None
                name, sign = b[2], b[5]
                hs = 0 if "H" not in t[1 + len(b[1] or "") + len(name) :] else int(b[4] or 1)
                if sign:
                    digits = sign.lstrip("+-")
                    charge = (1 if sign[0] == "+" else -1) * (int(digits) if digits else len(sign))
            else:
                name = t
            m.elements.append(name.capitalize())
            m.aromatic.append(name[0].islower())
            m.charges.append(charge)
            m.hydrogens.append(-1 if hs is None else hs)
            m.bonds.append({})
            here = len(m) - 1
            m.places.append(at)
            m.marks.append(mark)
            m.before.append(-1 if last is None else last)
            if last is not None:
                value = ORDER[order] if order else (1.5 if m.aromatic[last] and m.aromatic[here] else 1)
                m.bonds[last][here] = m.bonds[here][last] = value
            last, order, mark = here, None, -1
    if stack or rings or not len(m):
        return None
    if any(m.aromatic):
        for a, b in _bridges(m):
            if m.bonds[a][b] == 1.5:  # two aromatic systems side by side
                m.bonds[a][b] = m.bonds[b][a] = 1
    for i, h in enumerate(m.hydrogens):
        if h < 0:
            m.hydrogens[i] = _implicit(m, i)
    return m


def _bridges(m: Molecule) -> list[tuple[int, int]]:
    """Bonds that are in no ring, by depth-first numbering."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    out = []
    for start in range(len(m)):
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack = [(start, -1, iter(m.bonds[start]))]
        while stack:
            i, parent, rest = stack[-1]
            j = next(rest, None)
            if j is None:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[i])
                    if low[i] > number[parent]:
                        out.append((parent, i))
            elif j not in number:
                number[j] = low[j] = len(number)
                stack.append((j, i, iter(m.bonds[j])))
            elif j != parent:
                low[i] = min(low[i], number[j])
    return out


#: Greater valences that some atoms may have: fixed values.
HIGHER = {"N": (3, 5), "P": (3, 5), "S": (2, 4, 6)}


def _implicit(m: Molecule, i: int) -> int:
    """Hydrogens that fill an atom written without brackets up to its next usual valence."""
    used = sum(m.bonds[i].values())
    used = int(used) if m.aromatic[i] else int(used + 0.5)
    if m.aromatic[i]:
        return max(0, VALENCE.get(m.elements[i], 0) - used)
    return next((v - used for v in HIGHER.get(m.elements[i], (VALENCE.get(m.elements[i], 0),)) if v >= used), 0)


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest(repr(parts).encode()) & 0x7FFFFFFF


def refined(m: Molecule, atoms: Iterable[int] | None = None, plain: bool = False) -> dict[int, int]:
    """A class for each atom that depends on its whole surroundings and not on how the line was written."""
    atoms = set(range(len(m)) if atoms is None else atoms)
    label = lambda i: (m.elements[i], m.aromatic[i]) if plain else (m.elements[i], m.aromatic[i], m.charges[i], m.hydrogens[i])
    now = {i: xxhash.xxh64_intdigest(repr((label(i), sum(j in atoms for j in m.bonds[i]))).encode()) for i in atoms}
    kinds = len(set(now.values()))
    for _ in range(len(atoms)):
        new = {i: xxhash.xxh64_intdigest(repr((now[i], sorted((order, now[j]) for j, order in m.bonds[i].items() if j in atoms))).encode()) for i in atoms}
        now, before = new, kinds
        kinds = len(set(now.values()))
        if kinds in (before, len(atoms)):
            break
    return now


def write(m: Molecule, atoms: Iterable[int] | None = None, plain: bool = False) -> str:
    """A line for the atoms (all of them where none are given) that is the same however the molecule was written; `plain`
    leaves out charges and hydrogens that are cut off. Marks of stereochemistry are not written."""
    atoms = sorted(set(range(len(m)) if atoms is None else atoms))
    rank = refined(m, atoms, plain)
    # Ties are broken one at a time, and each break is spread, so that equal atoms get places by their surroundings.
    order = dict(zip(atoms, (0,) * len(atoms), strict=True))
    while True:
        values = {v: k for k, v in enumerate(sorted(set(rank.values())))}
        order = {i: values[rank[i]] for i in atoms}
        if len(values) == len(atoms):
            break
        counts = Counter(order.values())
        tied = min(v for v, n in counts.items() if n > 1)
        first = min(i for i in atoms if order[i] == tied)
        rank = {i: 2 * order[i] + 1 for i in atoms} | {first: 2 * order[first]}
        for _ in range(len(atoms)):
            new = {i: (rank[i], sorted((o, rank[j]) for j, o in m.bonds[i].items() if j in rank)) for i in atoms}
            places = {repr(v): k for k, v in enumerate(sorted(new.values()))}
            spread = {i: places[repr(new[i])] for i in atoms}
            if len(set(spread.values())) == len(set(rank.values())):
                break
            rank = spread
    inside, seen, closures, numbers = set(atoms), set(), {}, {}

    def mark(a: int, b: int) -> str:
        o = m.bonds[a][b]
        both = m.aromatic[a] and m.aromatic[b]
        return {1: "-" if both else "", 1.5: "" if both else ":", 2: "=", 3: "#", 4: "$"}.get(o, "")

    def atom(i: int) -> str:
        name = m.elements[i].lower() if m.aromatic[i] else m.elements[i]
        if m.elements[i] in VALENCE and (plain or (m.charges[i] == 0 and m.hydrogens[i] == _implicit(m, i))):
            return name
        h = "" if plain or not m.hydrogens[i] else "H" + (str(m.hydrogens[i]) if m.hydrogens[i] > 1 else "")
        c = "" if plain or not m.charges[i] else ("+" if m.charges[i] > 0 else "-") + (str(abs(m.charges[i])) if abs(m.charges[i]) > 1 else "")
        return f"[{name}{h}{c}]"

    def near(i: int) -> list[int]:
        return sorted((j for j in m.bonds[i] if j in inside), key=order.get)

    def find(start: int) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
        children, back, stack, parent = {start: []}, [], [(start, iter(near(start)))], {start: -1}
        while stack:
            i, rest = stack[-1]
            j = next(rest, None)
            if j is None:
                stack.pop()
            elif j not in parent:
                parent[j] = i
                children[i].append(j)
                children[j] = []
                stack.append((j, iter(near(j))))
            elif parent[i] != j and (j, i) not in back and (i, j) not in back:
                back.append((i, j))
        return children, back

    parts = []
    for start in sorted(atoms, key=order.get):
        if start in seen:
            continue
        children, back = find(start)
        seen |= set(children)
        closures = {}
        for n, (i, j) in enumerate(back, 1):
            closures.setdefault(j, []).append((n, i))
            closures.setdefault(i, []).append((n, j))
        opened, out, stack = set(), [], [(start, "")]
        while stack:
            item, lead = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            digits = ""
            for n, other in closures.get(item, []):
                digits += ("" if n in opened else mark(item, other)) + (str(n) if n < 10 else f"%{n}" if n < 100 else f"%({n})")
                opened.add(n)
            out.append(lead + atom(item) + digits)
            kids = children[item]
            following = []
            for k, child in enumerate(kids):
                if k < len(kids) - 1:
                    following += [("(", ""), (child, mark(item, child)), (")", "")]
                else:
                    following.append((child, mark(item, child)))
            stack += following[::-1]
        parts.append("".join(out))
    return ".".join(sorted(parts))


def _invariants(m: Molecule, features: bool = False) -> list[int]:
    if features:
        return [_hash(m.aromatic[i], m.elements[i] in ("N", "O"), m.elements[i] in ("F", "Cl", "Br", "I"), m.charges[i] > 0, m.charges[i] < 0) for i in range(len(m))]
    return [_hash(m.elements[i], m.aromatic[i], m.charges[i], m.hydrogens[i], len(m.bonds[i])) for i in range(len(m))]


def circular_bits(m: Molecule, radius: int, n_bits: int, features: bool = False) -> list[int]:
    """Bits of the environments of all atoms up to a radius."""
    now = _invariants(m, features)
    found = set(now)
    for _ in range(radius):
        now = [_hash(now[i], sorted((order, now[j]) for j, order in m.bonds[i].items())) for i in range(len(m))]
        found.update(now)
    return sorted({h % n_bits for h in found})


def path_bits(m: Molecule, longest: int, n_bits: int) -> list[int]:
    """Two bits for each linear path of 1 to `longest` bonds."""
    labels, bits = [(m.elements[i], m.aromatic[i]) for i in range(len(m))], set()

    def walk(path: list[int], text: tuple) -> None:
        if len(path) > 1:
            back = text[::-1]
            h = _hash(min(repr(text), repr(back)))
            bits.update((h % n_bits, _hash(h) % n_bits))
        if len(path) <= longest:
            for j, order in m.bonds[path[-1]].items():
                if j not in path:
                    walk([*path, j], (*text, order, labels[j]))

    for i in range(len(m)):
        walk([i], (labels[i],))
    return sorted(bits)


def descriptors(m: Molecule) -> list[float]:
    """The values of `DESCRIPTORS`, in that order: counts, mass and indices of the graph."""
    n, elements = len(m), Counter(m.elements)
    rings = patterns.rings_of(m)
    in_ring = {frozenset((r[k - 1], r[k])) for r in rings for k in range(len(r))}
    aromatic = [r for r in rings if all(m.aromatic[i] for i in r)]
    hetero = lambda r: any(m.elements[i] != "C" for i in r)
    bonds = [(i, j, o) for i in range(n) for j, o in m.bonds[i].items() if i < j]
    degree = [len(m.bonds[i]) for i in range(n)]
    heavy = [i for i in range(n) if m.elements[i] != "H"]
    mass = sum(MASS.get(e, 0.0) for e in m.elements) + MASS["H"] * sum(m.hydrogens)
    sp3 = sum(m.elements[i] == "C" and not m.aromatic[i] and all(o == 1 for o in m.bonds[i].values()) for i in range(n))
    turning = sum(o == 1 and degree[i] > 1 and degree[j] > 1 and frozenset((i, j)) not in in_ring for i, j, o in bonds)
    steps, far = [], 0
    for start in heavy:
        seen, layer, d = {start}, [start], 0
        while layer:
            layer, d = [j for i in layer for j in m.bonds[i] if j not in seen and not seen.add(j)], d + 1
            far, steps = max(far, d if layer else 0), [*steps, *([d] * len(layer))]
    paths2 = sum(d * (d - 1) // 2 for d in degree)
    paths3 = sum((degree[i] - 1) * (degree[j] - 1) for i, j, _ in bonds)
    a = len(heavy)
    kappa = lambda top, paths: top / paths**2 if paths else 0.0
    values = [
        a, round(mass, 3), len(rings), sum(m.aromatic), sum(e not in ("C", "H") for e in m.elements), sum(m.charges), len(m.components()), sum(elements[e] for e in ("F", "Cl", "Br", "I")),
        *(elements[e] for e in ("C", "N", "O", "S", "P", "F", "Cl", "Br", "I")), sum(m.hydrogens) + elements["H"], len(bonds), sum(o == 2 for *_, o in bonds), sum(o == 3 for *_, o in bonds),
        sum(m.elements[i] in ("N", "O") and m.hydrogens[i] > 0 for i in range(n)), sum(m.hydrogens[i] for i in range(n) if m.elements[i] in ("N", "O")), sum(m.elements[i] in ("N", "O") for i in range(n)),
        turning, sp3 / elements["C"] if elements["C"] else 0.0, len(aromatic), sum(map(hetero, aromatic)), len(rings) - len(aromatic), sum(map(hetero, rings)), max(map(len, rings), default=0),
        sum(steps) / 2, far, sum(degree[i] * degree[j] for i, j, _ in bonds), sum(d * d for d in degree), sum(d**-0.5 for d in degree if d), sum((degree[i] * degree[j]) ** -0.5 for i, j, _ in bonds),
        kappa(a * (a - 1) ** 2, len(bonds)), kappa((a - 1) * (a - 2) ** 2, paths2), kappa((a - 1) * (a - 3) ** 2 if a % 2 else (a - 3) * (a - 2) ** 2, paths3),
    ]
    return [float(v) for v in values]


DESCRIPTORS = (
    "heavy_atoms", "mass", "rings", "aromatic_atoms", "heteroatoms", "charge", "fragments", "halogens", "carbons", "nitrogens", "oxygens", "sulfurs", "phosphorus", "fluorines", "chlorines",
    "bromines", "iodines", "hydrogens", "bonds", "double_bonds", "triple_bonds", "donors", "donor_hydrogens", "acceptors", "rotatable_bonds", "fraction_sp3", "aromatic_rings",
    "aromatic_heterorings", "aliphatic_rings", "heterorings", "largest_ring", "wiener", "diameter", "zagreb_2", "zagreb_1", "chi_0", "chi_1", "kappa_1", "kappa_2", "kappa_3",
)
_OTHER: dict[str, Callable[[str], list]] = {}
NEEDS_TOOLKIT = ("Avalon", "GOBBI", "mordred")


def register(kind: str, compute: Callable[[str], list]) -> None:
    """Serve a feature kind by a function from text to a list of numbers."""
    _OTHER[kind] = compute


_KEYS: dict[str, tuple] = {}


def register_keys(kind: str, path: str) -> None:
    """Read a table of keys (bit, pattern and least number of matches, parted by tabs) for `MACCS`, or for the bits of
    `PubChem` that are patterns; its other bits need none."""
    _KEYS[kind] = patterns.read_keys(path)


def featurizer(kind: str) -> Callable[[Molecule], list]:
    """`RDK5..7` (paths), `ECFP2..6`, `FCFP2..6` (circular; the radius of FCFP is its number), `RDKdes` (descriptors)."""
    digit = int(kind[-1]) if kind[-1].isdigit() else 0
    if kind in ("RDK5", "RDK6", "RDK7"):
        return lambda m: path_bits(m, digit, 2048 if digit <= 6 else 4096)
    if kind in ("ECFP2", "ECFP4", "ECFP6"):
        return lambda m: circular_bits(m, digit // 2, 2048 if digit < 6 else 4096)
    if kind in ("FCFP2", "FCFP4", "FCFP6"):
        return lambda m: circular_bits(m, digit, 2048 if digit < 6 else 4096, True)
    if kind == "RDKdes":
        return descriptors
    if kind == "PubChem":
        return lambda m: patterns.pubchem_bits(m, _KEYS.get("PubChem", ()))
    if kind == "MACCS" and "MACCS" in _KEYS:
        return lambda m: patterns.key_bits(m, _KEYS["MACCS"])
    if kind == "MACCS":
        raise MissingBackend("MACCS needs its table of keys: register_keys('MACCS', path)")
    if kind in NEEDS_TOOLKIT:
        raise MissingBackend(f"{kind} needs a chemistry toolkit; register one")
    raise ValueError(f"unknown feature kind {kind}")


def features(col: Column, kind: str) -> Column:
    """Set bits as an array of whole numbers, or descriptors as an array of doubles; null where the text cannot be read."""
    if kind in _OTHER:
        own = _OTHER[kind]

        def run(text: str):
            return [float(v) for v in own(text)]

        result = DoubleType()
    else:
        compute = featurizer(kind)

        def run(text: str):
            m = parse(text)
            return None if m is None else compute(m)

        result = DoubleType() if kind == "RDKdes" else IntegerType()

    @F.pandas_udf(ArrayType(result))
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(run, na_action="ignore")

    return batch(col)


def scaffold(col: Column) -> Column:
    """The rings and what links them as a line, without charges and side chains; empty for chains, null where the text
    cannot be read."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (m := parse(t)) is None else write(m, m.core(), plain=True), na_action="ignore")

    return run(col)


def canonical(col: Column) -> Column:
    """One line for each molecule, however it was written, without marks of stereochemistry; null where it cannot be read."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (m := parse(t)) is None else write(m), na_action="ignore")

    return run(col)


def generate(df: DataFrame, text_col: str, kinds: list[str], standardizer=None) -> dict[str, DataFrame]:
    """A feature table for each kind: the input's columns, the standardised text and `features`; unreadable rows are left
    out. `standardizer` (`functions.standardise.Standardizer`): None takes the text as it is."""
    out = df if standardizer is None else df.withColumn(f"standardized_{text_col}", standardizer.column(F.col(text_col)))
    source = text_col if standardizer is None else f"standardized_{text_col}"
    return {k: out.withColumn("features", features(F.col(source), k)).where("features is not null") for k in kinds}


def unreadable(df: DataFrame, text_col: str) -> DataFrame:
    """The rows that `generate` leaves out."""
    return df.where(canonical(F.col(text_col)).isNull())
