"""SMILES: grammar check, graph, and a key that is the same however a ligand is written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

# The chemical symbols.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
# Aromatic symbols allowed in brackets, and the atoms allowed without them.
AROMATIC = "b c n o p s se as te".split()
BARE = "Br Cl B C N O P S F I b c n o p s *".split()

NUMBER = {s: i + 1 for i, s in enumerate(ELEMENTS)} | {s: ELEMENTS.index(s.capitalize()) + 1 for s in AROMATIC} | {"*": 0}

_TOKEN = re.compile(r"Br|Cl|[BCNOPSFIbcnops*]|\[[^\[\]]*\]|%\d\d|%\(\d+\)|[0-9]|[-=#:/\\~]|[().]", re.ASCII)
_BRACKET = re.compile(
    r"\[\d*(?P<symbol>" + "|".join(sorted([*ELEMENTS, *AROMATIC, r"\*"], key=lambda s: -len(s))) + r")"
    r"(?:@(?:@|TH[12]|AL[12]|SP[1-3]|TB\d{1,2}|OH\d{1,2})?)?(?:H\d?)?(?:\++|-+|\+\d{1,2}|-\d{1,2})?(?::\d+)?\]",
    re.ASCII,
)
_KIND = {s: "a" for s in BARE} | {s: "b" for s in "-=#:/\\~"} | {str(d): "r" for d in range(10)} | {s: s for s in "()."}
_ORDER = {"=": 1, "#": 2}
_bracket_number: dict[str, int | None] = {}


def _bracket(token: str) -> int | None:
    found = _bracket_number.get(token, -1)
    if found == -1:
        m = _BRACKET.fullmatch(token)
        found = None if m is None else NUMBER[m["symbol"]] + (1000 if m["symbol"][0].islower() else 0)
        if len(_bracket_number) < 100_000:
            _bracket_number[token] = found
    return found


_BARE_NUMBER = {s: NUMBER[s] + (1000 if s[0].islower() else 0) for s in BARE}


def read_into(text: str, atoms: list[int], us: list[int], vs: list[int], orders: list[tuple[int, int]]) -> list[int] | None | bool:
    """Append the atoms, the bonds' ends and the places of double and triple bonds of ``text`` to the lists.

    Returns the part of each atom (None in place of one part), or False where ``text`` isn't SMILES; the
    lists then hold remains, which the caller cuts off. An atom is its element number, plus 1000 if
    written as aromatic. Blanks aren't removed here.
    """
    tokens = _TOKEN.findall(text)
    if not tokens or len("".join(tokens)) != len(text):
        return False
    base = len(atoms)
    stack: list[int] = []
    rings: dict[str, tuple[int, str]] = {}
    cut = False
    at, bond, last = -1, "", ""
    kind_of, bare, add, add_u, add_v = _KIND.get, _BARE_NUMBER.get, atoms.append, us.append, vs.append
    here = base - 1
    for t in tokens:
        kind = kind_of(t) or ("r" if t[0] == "%" else "a")
        if kind == "a":
            number = bare(t)
            if number is None:
                number = _bracket(t)
                if number is None:
                    return False
            here += 1
            add(number)
            if at >= 0:
                add_u(at)
                add_v(here)
                if bond:
                    if bond in _ORDER:
                        orders.append((len(us) - 1, _ORDER[bond]))
                    bond = ""
            elif bond:
                return False
            at = here
        elif kind == "(":
            if at < 0 or bond or last == "(":
                return False
            stack.append(at)
        elif kind == ")":
            if not stack or bond or last == "(" or last == ".":
                return False
            at = stack.pop()
        elif kind == "r":
            if at < 0 or last == "(":
                return False
            name = t if t[0] != "%" else t.strip("%()").lstrip("0") or "0"
            opened = rings.pop(name, None)
            if opened is None:
                rings[name] = (at, bond)
            else:
                other, ob = opened
                if other == at or (bond and ob and bond != ob and not (bond in "/\\" and ob in "/\\")):
                    return False
                add_u(other)
                add_v(at)
                if (bond or ob) in _ORDER:
                    orders.append((len(us) - 1, _ORDER[bond or ob]))
            bond = ""
        elif kind == "b":
            if bond or at < 0:
                return False
            bond = t
        else:
            if at < 0 or bond or last == ".":
                return False
            at = -1
            cut = True
        last = kind
    if stack or rings or bond or at < 0:
        return False
    return _parts(base, here + 1, us, vs) if cut else None


def parse(text: str) -> tuple[list[int], list[tuple[int, int, int]], list[int]] | None:
    """Atoms, bonds ``(atom, atom, 1 if double, 2 if triple, else 0)`` and each atom's part, or None where
    ``text`` isn't SMILES."""
    atoms: list[int] = []
    us: list[int] = []
    vs: list[int] = []
    orders: list[tuple[int, int]] = []
    part = read_into(text, atoms, us, vs, orders)
    if part is False:
        return None
    by = dict(orders)
    return atoms, [(u, v, by.get(i, 0)) for i, (u, v) in enumerate(zip(us, vs))], part or [0] * len(atoms)


def _parts(base: int, end: int, us: list[int], vs: list[int]) -> list[int]:
    root = list(range(end - base))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(len(us) - 1, -1, -1):
        if us[k] < base:
            break
        root[top(us[k] - base)] = top(vs[k] - base)
    names: dict[int, int] = {}
    return [names.setdefault(top(i), len(names)) for i in range(end - base)]


def write_smiles(symbols: list[str], bonds: list[tuple[int, int, int]]) -> str:
    """A SMILES text of a graph of element symbols and bonds ``(atom, atom, order)``, order 4 being aromatic; "" without atoms.

    Symbols that need no brackets are written bare, so hydrogens follow from the valence.
    """
    near: list[list[tuple[int, str]]] = [[] for _ in symbols]
    marks = {1: "", 2: "=", 3: "#", 4: ":"}
    for a, b, order in bonds:
        near[a].append((b, marks.get(order, "")))
        near[b].append((a, marks.get(order, "")))
    atom = [s if s in BARE else f"[{s}]" for s in symbols]
    seen: set[int] = set()
    whole = []
    for root in range(len(symbols)):
        if root in seen:
            continue
        # The tree of a depth-first walk; what closes rings is numbered at both ends.
        children: dict[int, list[tuple[int, str]]] = {}
        rings: dict[int, list[str]] = {}
        parent = {root: -1}
        todo = [(root, iter(near[root]))]
        seen.add(root)
        number = 0
        closed: set[tuple[int, int]] = set()
        while todo:
            at, rest = todo[-1]
            step = next(rest, None)
            if step is None:
                todo.pop()
                continue
            to, mark = step
            if to not in seen:
                seen.add(to)
                parent[to] = at
                children.setdefault(at, []).append((to, mark))
                todo.append((to, iter(near[to])))
            elif to != parent[at] and (min(at, to), max(at, to)) not in closed:
                closed.add((min(at, to), max(at, to)))
                number += 1
                name = str(number) if number < 10 else f"%{number:02d}" if number < 100 else f"%({number})"
                rings.setdefault(at, []).append(mark + name)
                rings.setdefault(to, []).append(name)
        parts: list[str] = []
        stack: list[tuple[str, int]] = [("", root)]
        while stack:
            mark, at = stack.pop()
            if at < 0:
                parts.append(mark)
                continue
            parts.append(mark + atom[at] + "".join(rings.get(at, ())))
            below = children.get(at, [])
            # The last branch needs no parentheses.
            for i, (to, m) in reversed(list(enumerate(below))):
                if i < len(below) - 1:
                    stack.append((")", -1))
                    stack.append((m, to))
                    stack.append(("(", -1))
                else:
                    stack.append((m, to))
        whole.append("".join(parts))
    return ".".join(whole)


def is_molecule(text: str | None) -> bool:
    """Whether the text, blanks around it removed, is one SMILES by the grammar."""
    return text is not None and parse(text.strip()) is not None


_ROUNDS = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


class Graphs:
    """The molecules of a batch of texts in flat arrays: atoms of the largest parts, without hydrogens."""

    def __init__(self, texts: list[str | None]) -> None:
        atoms: list[int] = []
        us: list[int] = []
        vs: list[int] = []
        orders: list[tuple[int, int]] = []
        gone: list[int] = []
        self.which: list[int] = []
        self.starts: list[int] = []
        self.n = len(texts)
        for i, text in enumerate(texts):
            if text is None:
                continue
            base, bonds, marks = len(atoms), len(us), len(orders)
            part = read_into(text.strip(), atoms, us, vs, orders)
            if part is False:
                del atoms[base:], us[bonds:], vs[bonds:], orders[marks:]
                continue
            self.which.append(i)
            self.starts.append(base)
            if part is not None:
                sizes: dict[int, int] = {}
                for p, x in zip(part, atoms[base:]):
                    sizes[p] = sizes.get(p, 0) + (x != 1)
                most = max(sizes.values())
                chosen = min((p for p, n in sizes.items() if n == most), key=lambda p: sorted(x % 1000 for x, q in zip(atoms[base:], part) if q == p))
                gone += [base + j for j, p in enumerate(part) if p != chosen]
        written = np.array(atoms, dtype=np.int64)
        self.number, flag = written % 1000, (written > 1000).astype(np.int64)
        u, v = np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)
        order = np.zeros(len(u), dtype=np.int64)
        if orders:
            place, value = np.array(orders, dtype=np.int64).T
            order[place] = value
            for end in (u, v):
                for o in (1, 2):
                    hit = end[place[value == o]]
                    flag[hit] = np.maximum(flag[hit], o)
        self.keep = self.number != 1
        self.keep[gone] = False
        self.label = self.number * 4 + np.where(self.number == 6, flag, 0) + 17
        live = self.keep[u] & self.keep[v]
        self.u, self.v, self.order = u[live], v[live], order[live]

    def states(self, rounds: int, keep: np.ndarray) -> Iterator[np.ndarray]:
        """The atoms' states after 0, 1, ... rounds of taking in their neighbours', within ``keep``."""
        state = _mix(self.label.astype(np.uint64, copy=False))
        live = keep[self.u] & keep[self.v]
        d, s = np.r_[self.u[live], self.v[live]], np.r_[self.v[live], self.u[live]]
        sort = np.argsort(d, kind="stable")
        s, d = s[sort], d[sort]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.array([], np.int64)
        near = np.zeros_like(state)
        yield state
        for _ in range(rounds):
            if len(d):
                near[d[first]] = np.add.reduceat(_mix(state)[s], first)
            state = _mix(state * _M2 + near)
            yield state

    def keys(self, keep: np.ndarray) -> list[tuple[int, int] | None]:
        """Two hashes per text: of all atoms' states, and of these after one of equal atoms is singled out, for each of them.

        Neighbours' states alone can't tell some rings apart, such as two fused six-rings from two linked five-rings.
        Where atoms of rings have equal states, the fewest such are singled out in turn in copies of the molecule.
        """
        out: list[tuple[int, int] | None] = [None] * self.n
        if not self.which:
            return out
        for state in self.states(_ROUNDS, keep):
            pass
        starts = np.array(self.starts, np.int64)
        total = np.add.reduceat(np.where(keep, _mix(state), np.uint64(0)), starts)
        second = np.add.reduceat(np.where(keep, _mix(state ^ _M1), np.uint64(0)), starts)
        second += self._singled_out(state, keep & self.core(), keep, starts)
        for i, x, y in zip(self.which, total.view(np.int64).tolist(), second.view(np.int64).tolist()):
            out[i] = (x, y)
        return out

    def _singled_out(self, state: np.ndarray, ring: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.r_[starts[1:], len(keep)]
        mol = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.flatnonzero(ring)
        at = at[np.lexsort((state[at], mol[at]))]
        none = np.zeros(len(starts), np.uint64)
        if not len(at):
            return none
        new = np.r_[True, (state[at[1:]] != state[at[:-1]]) | (mol[at[1:]] != mol[at[:-1]])]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        first = at[new]
        tied = np.flatnonzero(size > 1)
        if not len(tied):
            return none
        # Of each molecule the smallest group of equal atoms, the least state of equal sizes.
        best = tied[np.lexsort((state[first[tied]], size[tied], mol[first[tied]]))]
        best = best[np.r_[True, mol[first[best[1:]]] != mol[first[best[:-1]]]]]
        chosen = at[np.isin(group, best)]
        of = mol[chosen]
        lengths = (ends - starts)[of]
        base = np.cumsum(lengths) - lengths
        back = np.repeat(starts[of] - base, lengths) + np.arange(lengths.sum())
        copy = object.__new__(Graphs)
        copy.label = state[back].copy()
        copy.label[base + chosen - starts[of]] ^= _M1
        # Bonds lie in the order of their molecules.
        owner = mol[self.u]
        order = np.argsort(owner, kind="stable")
        many = np.bincount(owner, minlength=len(starts))
        begin = np.cumsum(many) - many
        reps = many[of]
        shift = np.repeat(base - starts[of], reps)
        bond = order[np.repeat(begin[of] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
        copy.u, copy.v = self.u[bond] + shift, self.v[bond] + shift
        for last in copy.states(_ROUNDS, keep[back]):
            pass
        whole = np.add.reduceat(np.where(keep[back], _mix(last), np.uint64(0)), base)
        np.add.at(none, of, _mix(whole))
        return none

    def core(self) -> np.ndarray:
        """Atoms of rings, of chains between rings, and those bound to them by a double or triple bond."""
        keep = self.keep.copy()
        while True:
            live = keep[self.u] & keep[self.v]
            degree = np.bincount(self.u[live], minlength=len(keep)) + np.bincount(self.v[live], minlength=len(keep))
            leaf = keep & (degree < 2)
            if not leaf.any():
                break
            keep &= ~leaf
        side = self.order > 0
        back = np.r_[self.v[side & keep[self.u]], self.u[side & keep[self.v]]]
        keep[back] = True
        return keep


def ligand_keys(texts: list[str | None]) -> list[tuple[int, int] | None]:
    """A pair of signed 64-bit numbers for each text: the same for the same atoms and connections of the
    largest part. None for a null text or one that isn't SMILES.

    Charges, isotopes, hydrogens, stereo marks, smaller parts, blanks, atom order, ring numbers and the
    style of aromatic rings don't matter. Bonds have no order in the key; instead each carbon knows if it
    is saturated, takes part in a double or aromatic bond, or in a triple one, which is the same for both
    styles. Every atom's state takes in its neighbours' for 16 rounds; the key sums the final states, the second
    number those with equal ring atoms singled out as well.
    """
    g = Graphs(texts)
    return g.keys(g.keep)


def same_ligands(left: list[str | None], right: list[str | None]) -> list[bool]:
    """Whether the texts of each pair are the same ligand, by a match of all atoms and bonds of their largest parts.

    The same marks count as for the keys. Texts that can't be read are the same as nothing.
    """
    out: list[bool] = []
    for lo in range(0, len(left), 2048):
        a, b = left[lo : lo + 2048], right[lo : lo + 2048]
        g = Graphs([*a, *b])
        state = None
        for state in g.states(_ROUNDS, g.keep):
            pass
        near: dict[int, list[int]] = {}
        for u, v in zip(g.u.tolist(), g.v.tolist()):
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        ends = dict(zip(g.which, zip(g.starts, [*g.starts[1:], len(g.keep)])))
        colour = state.tolist() if state is not None else []
        alive = g.keep.tolist()
        for i in range(len(a)):
            x, y = ends.get(i), ends.get(i + len(a))
            out.append(x is not None and y is not None and _matches([k for k in range(*x) if alive[k]], [k for k in range(*y) if alive[k]], near, colour))
    return out


def _matches(xs: list[int], ys: list[int], near: dict[int, list[int]], colour: list[int]) -> bool:
    """Whether some one-to-one map of atoms keeps colours and bonds; tried atom by atom along the bonds."""
    if sorted(colour[k] for k in xs) != sorted(colour[k] for k in ys):
        return False
    order: list[tuple[int, int]] = []
    seen: set[int] = set()
    for root in xs:
        todo = [(root, -1)]
        while todo:
            k, parent = todo.pop()
            if k not in seen:
                seen.add(k)
                order.append((k, parent))
                todo += [(m, k) for m in near.get(k, ()) if m not in seen]
    place = {k: i for i, (k, _) in enumerate(order)}
    back = [[m for m in near.get(k, ()) if place[m] < i] for i, (k, _) in enumerate(order)]
    to: dict[int, int] = {}
    used: set[int] = set()

    def ways(i: int) -> Iterator[int]:
        k, parent = order[i]
        for y in near.get(to[parent], ()) if parent >= 0 else ys:
            if y not in used and colour[y] == colour[k] and len(near.get(y, ())) == len(near.get(k, ())) and all(to[m] in near[y] for m in back[i]):
                yield y

    stack = [ways(0)] if order else []
    while stack:
        k = order[len(stack) - 1][0]
        if k in to:
            used.discard(to.pop(k))
        y = next(stack[-1], None)
        if y is None:
            stack.pop()
            continue
        to[k] = y
        used.add(y)
        if len(stack) == len(order):
            return True
        stack.append(ways(len(stack)))
    return not order


def scaffold_keys(texts: list[str | None]) -> list[tuple[int, int] | None]:
    """The same for the ring systems and the chains between them; None without rings."""
    g = Graphs(texts)
    if not g.which:
        return [None] * len(texts)
    core = g.core()
    some = np.add.reduceat(core.astype(np.int64), g.starts) > 0
    out = g.keys(core)
    for i, s in zip(g.which, some.tolist()):
        if not s:
            out[i] = None
    return out


def circular_bits(texts: list[str | None], radius: int = 2, size: int = 2048) -> list[list[int] | None]:
    """Positions set in a circular fingerprint: one per atom and radius, by our own hash of its surroundings."""
    g = Graphs(texts)
    out: list[list[int] | None] = [None] * len(texts)
    if not g.which:
        return out
    ends = [*g.starts[1:], len(g.keep)]
    bits = [(s % np.uint64(size)).astype(np.int64) for s in g.states(radius, g.keep)]
    for i, a, b in zip(g.which, g.starts, ends):
        live = g.keep[a:b]
        out[i] = np.unique(np.concatenate([x[a:b][live] for x in bits])).tolist()
    return out
