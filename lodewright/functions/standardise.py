"""Standardising structures by edits of the written line, so that order, rings and marks of stereochemistry stay.

Each step changes tokens of atoms and bonds found on the molecule and reads the result again; a step that would make a
line unreadable is undone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodewright.functions.chem import BRACKET, Molecule, parse, refined, write

#: Counter-ions and solvents that salts are stripped of: fixed values, in canonical lines.
SALT_LINES = ("Cl", "Br", "I", "F", "[Na+]", "[K+]", "[Li+]", "[Ca+2]", "[Mg+2]", "[Cl-]", "[Br-]", "[I-]", "O", "OS(=O)(=O)O", "OC(=O)C(=O)O", "OP(=O)(O)O", "CS(=O)(=O)O", "OC(=O)C(F)(F)F", "CC(=O)O", "OC(=O)C=CC(=O)O", "[NH4+]", "[O-]S(=O)(=O)[O-]", "OCl(=O)(=O)=O", "CO", "CCO")
_SALTS: set[str] = set()


def _salts() -> set[str]:
    if not _SALTS:
        _SALTS.update(write(m) for line in SALT_LINES if (m := parse(line)) is not None)
    return _SALTS


def _set_atom(m: Molecule, i: int, charge: int | None = None, hydrogens: int | None = None) -> None:
    """Rewrite an atom's token with another charge or number of hydrogens; its other marks stay."""
    t = m.tokens[m.places[i]]
    charge = m.charges[i] if charge is None else charge
    mark, mass, number = "", "", ""
    if t[0] == "[":
        b = BRACKET.match(t)
        mass, name, mark = b[1] or "", b[2], b[3]
        number = n[0] if (n := re.search(r":\d+(?=\]$)", t)) else ""
        hydrogens = m.hydrogens[i] if hydrogens is None else hydrogens
    else:
        name = t
        hydrogens = m.hydrogens[i] if hydrogens is None else hydrogens
    h = "" if not hydrogens else "H" if hydrogens == 1 else f"H{hydrogens}"
    c = "" if not charge else ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")
    m.tokens[m.places[i]] = f"[{mass}{name}{mark}{h}{c}{number}]"


def _set_bond(m: Molecule, i: int, mark: str) -> None:
    """Another mark on the bond between an atom and the one it is written after."""
    if m.marks[i] >= 0:
        m.tokens[m.marks[i]] = mark
    elif mark:
        m.tokens[m.places[i]] = mark + m.tokens[m.places[i]]


def _line(m: Molecule) -> str:
    """The tokens as a line, with brackets taken off where they say nothing."""
    text = "".join(m.tokens)
    plain = parse(text)
    if plain is None:
        return text
    for i, at in enumerate(plain.places):
        t = plain.tokens[at]
        b = BRACKET.match(t) if t[0] == "[" else None
        if b and not b[1] and not b[3] and not plain.charges[i] and ":" not in t and t[1:2].upper() in "BCNOPSFI" and len(b[2]) <= 2:
            bare = list(plain.tokens)
            bare[at] = b[2]
            other = parse("".join(bare))
            if other is not None and other.elements[i] == plain.elements[i] and other.hydrogens[i] == plain.hydrogens[i]:
                plain.tokens[at] = b[2]
    return "".join(plain.tokens)


def remove_hydrogens(m: Molecule) -> str:
    """Hydrogens written as atoms join the count of their atom; single ones and isotopes stay."""
    for i in range(len(m)):
        if m.elements[i] != "H" or len(m.bonds[i]) != 1 or m.charges[i] or re.match(r"\[\d", m.tokens[m.places[i]]):
            continue
        (j,) = m.bonds[i]
        if m.elements[j] == "H":
            continue
        leaf, at = m.before[i] == j, m.places[i]
        if leaf:
            m.hydrogens[j] += 1
            _set_atom(m, j, hydrogens=m.hydrogens[j])
            m.tokens[at] = ""
            if m.marks[i] >= 0:
                m.tokens[m.marks[i]] = ""
            if at and at + 1 < len(m.tokens) and m.tokens[at + 1] == ")":
                k = at - 1
                while k >= 0 and m.tokens[k] == "":
                    k -= 1
                if m.tokens[k] == "(":
                    m.tokens[k] = m.tokens[at + 1] = ""
        elif at + 1 < len(m.tokens) and m.before[j] == i and m.places[j] == at + 1 and at == 0:
            m.hydrogens[j] += 1
            _set_atom(m, j, hydrogens=m.hydrogens[j])
            m.tokens[at] = ""
    return "".join(m.tokens)


def normalise(m: Molecule) -> str:
    """Groups with five bonds at nitrogen get charges: nitro groups, azides, N-oxides; a charged pair at sulphur or
    phosphorus becomes a double bond."""
    for i in range(len(m)):
        if m.elements[i] == "N" and m.charges[i] == 0 and not m.aromatic[i] and sum(m.bonds[i].values()) >= 5:
            for j, order in m.bonds[i].items():
                ends = (m.elements[j] == "O" and order == 2) or (m.elements[j] == "N" and order == 3)
                if ends and m.before[j] == i and len(m.bonds[j]) == 1 and m.charges[j] == 0:
                    _set_bond(m, j, "" if order == 2 else "=")
                    _set_atom(m, j, charge=-1, hydrogens=0)
                    _set_atom(m, i, charge=1, hydrogens=0)
                    break
        if m.elements[i] in ("S", "P") and m.charges[i] == 1:
            for j, order in m.bonds[i].items():
                if m.elements[j] == "O" and m.charges[j] == -1 and order == 1 and m.before[j] == i:
                    _set_bond(m, j, "=")
                    _set_atom(m, j, charge=0, hydrogens=0)
                    _set_atom(m, i, charge=0)
                    break
    return "".join(m.tokens)


def _acidity(m: Molecule, i: int) -> int | None:
    """Rank of the acid an oxygen or sulphur belongs to, the strongest first; None where it is none."""
    if m.elements[i] not in ("O", "S") or len(m.bonds[i]) != 1 or next(iter(m.bonds[i].values())) != 1:
        return None
    (j,) = m.bonds[i]
    double = sum(m.elements[k] == "O" and o == 2 for k, o in m.bonds[j].items())
    if m.elements[j] == "S" and double:
        return 0 if double >= 2 else 1
    if m.elements[j] == "P" and double:
        return 2
    if m.elements[j] == "C" and double:
        return 3
    if m.elements[i] == "S":
        return 4
    return 5 if m.aromatic[j] else 6


def reionise(m: Molecule) -> str:
    """Negative charges move to the strongest acids of the molecule that still have their hydrogen."""
    acids = sorted((r, i) for i in range(len(m)) if (r := _acidity(m, i)) is not None)
    charged = [(r, i) for r, i in acids if m.charges[i] == -1][::-1]
    free = [(r, i) for r, i in acids if m.charges[i] == 0 and m.hydrogens[i] == 1]
    for (weak, i), (strong, j) in zip(charged, free, strict=False):
        if strong < weak:
            _set_atom(m, i, charge=0, hydrogens=1)
            _set_atom(m, j, charge=-1, hydrogens=0)
    return "".join(m.tokens)


def uncharge(m: Molecule) -> str:
    """Charges that hydrogens can undo are undone; those beside an opposite charge (nitro groups) stay, and so does what
    balances a charge for good."""
    fixed = {i for i in range(len(m)) if m.charges[i] and any(m.charges[i] * m.charges[j] < 0 for j in m.bonds[i])}
    quaternary = sum(m.charges[i] for i in range(len(m)) if m.charges[i] > 0 and i not in fixed and not m.hydrogens[i])
    for i in range(len(m)):
        c = m.charges[i]
        if not c or i in fixed or m.elements[i] not in ("B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I"):
            continue
        if c > 0 and m.hydrogens[i] >= c:
            _set_atom(m, i, charge=0, hydrogens=m.hydrogens[i] - c)
        elif c < 0:
            if quaternary >= -c:
                quaternary += c
                continue
            _set_atom(m, i, charge=0, hydrogens=m.hydrogens[i] - c)
    return "".join(m.tokens)


def tautomer(m: Molecule) -> str:
    """Enols and imidic acids take the form with the double bond at oxygen, one shift after another."""
    for i in range(len(m)):
        if m.elements[i] != "O" or m.hydrogens[i] != 1 or m.charges[i] or len(m.bonds[i]) != 1:
            continue
        (c,) = m.bonds[i]
        if m.elements[c] != "C" or m.aromatic[c] or not (m.before[i] == c or m.before[c] == i):
            continue
        for x, order in m.bonds[c].items():
            if order == 2 and m.elements[x] in ("C", "N") and not m.aromatic[x] and not m.charges[x] and (m.before[x] == c or m.before[c] == x):
                _set_bond(m, i if m.before[i] == c else c, "=")
                _set_bond(m, x if m.before[x] == c else c, "")
                for k, h in ((i, 0), (x, m.hydrogens[x] + 1)):
                    if m.tokens[m.places[k]].lstrip("=-#")[0] == "[":
                        _set_atom(m, k, hydrogens=h)
                return "".join(m.tokens)
    return "".join(m.tokens)


def assign_stereo(m: Molecule) -> str:
    """Marks at atoms that cannot be centres, because two of their neighbours are alike, are taken off, and so are marks
    beside double bonds with two like ends."""
    kind = refined(m)
    for i in range(len(m)):
        t = m.tokens[m.places[i]]
        if "@" in t:
            around = [kind[j] for j in m.bonds[i]] + [0] * m.hydrogens[i]
            if len(around) < 3 or len(set(around)) < len(around):
                m.tokens[m.places[i]] = t.replace("@", "")
    real = False
    for i in range(len(m)):
        for j, order in m.bonds[i].items():
            if i < j and order == 2:
                ends = [[kind[k] for k in m.bonds[a] if k != b] + [0] * m.hydrogens[a] for a, b in ((i, j), (j, i))]
                real = real or all(e and len(set(e)) == len(e) for e in ends)
    if not real:
        m.tokens[:] = ["" if t in ("/", "\\") else t for t in m.tokens]
    return "".join(m.tokens)


STEPS = ("normalise", "tautomer", "salts", "reionise", "uncharge", "stereo", "drop_stereo", "largest", "hydrogens")


@dataclass(frozen=True)
class Standardizer:
    """Steps in a fixed order, each switched on by its name: charges of groups, tautomer, salts off, charges to the
    strongest acids, charges off, marks of stereochemistry checked or dropped, largest fragment, hydrogens off. What
    cannot be read is null; a step whose result cannot be read is left out."""

    normalise: bool = True
    tautomer: bool = True
    salts: bool = False
    reionise: bool = False
    uncharge: bool = False
    stereo: bool = True
    drop_stereo: bool = False
    largest: bool = False
    hydrogens: bool = True

    def one(self, text: str | None) -> str | None:
        if parse(text) is None:
            return None
        for step in STEPS:
            if not getattr(self, step):
                continue
            m = parse(text)
            if step == "salts":
                rest = [p for p in text.split(".") if (q := parse(p)) is None or write(q) not in _salts()]
                new = ".".join(rest) or text
            elif step == "largest":
                new = max(text.split("."), key=lambda p: (sum(e != "H" for e in q.elements) if (q := parse(p)) else 0)) if "." in text else text
            elif step == "drop_stereo":
                new = "".join("" if t in ("/", "\\") else t.replace("@", "") for t in m.tokens)
            elif step == "tautomer":
                new = text
                for _ in range(20):
                    shifted = tautomer(parse(new) or m)
                    if shifted == new or parse(shifted) is None:
                        break
                    new = shifted
            else:
                new = {"normalise": normalise, "reionise": reionise, "uncharge": uncharge, "stereo": assign_stereo, "hydrogens": remove_hydrogens}[step](m)
            if new != text and (done := parse(new)) is not None:
                text = _line(done)
        return text

    def column(self, col: Column) -> Column:
        @F.pandas_udf(StringType())
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(self.one, na_action="ignore")

        return run(col)
