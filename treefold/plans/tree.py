"""Join trees: which relation joins which, on what, and which columns are the matrix.

Neighbours join on the attributes they share by name; every other attribute is a feature. A feature column is named
``relation__attribute`` inside plans, so the same name may occur in several relations.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    """One relation in a tree. keys: all join attributes; parent_keys: those shared with the parent (root: its keys)."""

    name: str
    df: DataFrame
    children: list[Node] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    parent_keys: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    is_root: bool = False

    def walk(self) -> Iterator[Node]:
        """Preorder, which is the order of the matrix's columns."""
        yield self
        for c in self.children:
            yield from c.walk()

    def subtree_features(self) -> list[str]:
        return [f for n in self.walk() for f in n.features]


Shape = str | tuple


class JoinTree:
    """A natural join over a tree, e.g. JoinTree(("orders", "customer", ("lineitem", "part")), relations).

    shape: a name, or (name, child shapes...). skip: attributes to leave out. columns: per relation the attributes to use.
    """

    def __init__(self, shape: Shape, relations: Mapping[str, DataFrame], skip: Sequence[str] = (), columns: Mapping[str, Sequence[str]] | None = None, scale: Mapping[str, float] | None = None):
        self.shape = shape
        self.root = self._node(shape, relations, set(skip), columns or {})
        self.root.is_root = True
        self._analyse(scale or {})

    def _node(self, shape: Shape, relations, skip: set[str], columns) -> Node:
        name, *children = (shape,) if isinstance(shape, str) else shape
        df = relations[name]
        chosen = [c for c in columns.get(name, df.columns) if c not in skip]
        return Node(name, df.select(*chosen), [self._node(c, relations, skip, columns) for c in children])

    def _analyse(self, scale: Mapping[str, float]) -> None:
        self.nodes = list(self.root.walk())
        if len({n.name for n in self.nodes}) < len(self.nodes):
            raise ValueError("a relation occurs twice in the join tree")
        parent = {c.name: n for n in self.nodes for c in n.children}
        own = {n.name: n.df.columns for n in self.nodes}
        for n in self.nodes:
            up = own[parent[n.name].name] if n.name in parent else []
            near = {*up, *(a for c in n.children for a in own[c.name])}
            n.keys = [a for a in own[n.name] if a in near]
            n.parent_keys = [a for a in own[n.name] if a in up] if n.name in parent else list(n.keys)
            if n.name in parent and not n.parent_keys:
                raise ValueError(f"{n.name} shares no attribute with {parent[n.name].name}")
        # Running intersection: the relations that have an attribute must be connected, or the tree is not the natural join.
        for a in {a for names in own.values() for a in names}:
            holders = {n.name for n in self.nodes if a in own[n.name]}
            tops = [h for h in holders if h not in parent or parent[h].name not in holders]
            if len(tops) > 1 and any(a in n.keys for n in self.nodes):
                raise ValueError(f"attribute {a} occurs in {sorted(holders)}, which are not connected in the tree")
        for n in self.nodes:
            values = [a for a in own[n.name] if a not in n.keys]
            n.features = [f"{n.name}__{a}" for a in values]
            n.df = n.df.select(*n.keys, *[(F.col(a).cast("double") * scale[a] if a in scale else F.col(a).cast("double")).alias(f) for a, f in zip(values, n.features)])

    @property
    def features(self) -> list[str]:
        """The matrix's columns in order."""
        return self.root.subtree_features()

    def with_frames(self, frames: Mapping[str, DataFrame]) -> JoinTree:
        """The same tree over other rows."""
        out = object.__new__(JoinTree)
        out.shape = self.shape
        copy = lambda n: Node(n.name, frames.get(n.name, n.df), [copy(c) for c in n.children], n.keys, n.parent_keys, n.features, n.is_root)
        out.root = copy(self.root)
        out.nodes = list(out.root.walk())
        return out


def attributes_of(shape: Shape) -> list[str]:
    """Relation names in preorder."""
    return [shape] if isinstance(shape, str) else [shape[0], *(n for c in shape[1:] for n in attributes_of(c))]


def rooted_at(shape: Shape, root: str) -> Shape:
    """The same undirected tree with another root."""
    edges: dict[str, list[str]] = {n: [] for n in attributes_of(shape)}

    def collect(s: Shape) -> str:
        name, *children = (s,) if isinstance(s, str) else s
        for c in children:
            other = collect(c)
            edges[name].append(other)
            edges[other].append(name)
        return name

    collect(shape)

    def build(name: str, above: str | None) -> Shape:
        below = [build(o, name) for o in edges[name] if o != above]
        return (name, *below) if below else name

    return build(root, None)


def reduced_size(tree: JoinTree, sizes: Mapping[str, int], power: int = 2) -> int:
    """The cost of the blocks that the factorised passes hand to QR: sum of rows * columns ** power."""
    return sum(sizes[n.name] * (len(n.features) ** power + len(n.subtree_features()) ** power * bool(n.children)) for n in tree.nodes)


def best_root(shape: Shape, relations: Mapping[str, DataFrame], sizes: Mapping[str, int] | None = None, **names) -> Shape:
    """The rooting with the least reduced size."""
    sizes = sizes or {n: relations[n].count() for n in attributes_of(shape)}
    options = [rooted_at(shape, n) for n in attributes_of(shape)]
    return min(options, key=lambda s: (reduced_size(JoinTree(s, relations, **names), sizes), attributes_of(s)))
