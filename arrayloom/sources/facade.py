"""Files as Python objects: names lead to groups and datasets, datasets to numpy arrays. For a look at one file; many files are read by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np

from arrayloom.sources import container
from arrayloom.sources.datasource import opened

READABLE = ("f64", "f32", "i32", "i64", "u8", "u64", "string")


class Node:
    """What has attributes."""

    def __init__(self, box: container.Container, path: str, found: container.Dataset | container.Group):
        self._box, self.name, self._found = box, "/" + path, found

    @property
    def attrs(self) -> dict[str, object]:
        return dict(sorted(self._found.attributes.items()))


class ArrayNode(Node):
    @property
    def shape(self) -> tuple[int, ...]:
        return self._found.shape

    @property
    def dtype(self) -> str:
        return self._found.kind.name

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("a scalar has no length")
        return self.shape[0]

    def __getitem__(self, at: object) -> object:
        """Elements as numpy indexes them. Types that it can't give: TypeError."""
        kind = self._found.kind
        text = kind.name == "variable" and kind.padding == "string"
        if kind.name not in READABLE and not text:
            raise TypeError(f"{kind.name} can't be read")
        whole = self._box.array(self.name)
        if text or kind.name == "string":
            whole = np.array(container.decoded(whole, kind, self._box), object).reshape(whole.shape)
        return whole[at]


class GroupNode(Node):
    def keys(self) -> list[str]:
        return sorted([*self._found.links, *self._found.soft])

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __contains__(self, path: str) -> bool:
        try:
            self[path]
        except KeyError:
            return False
        return True

    def __getitem__(self, path: str) -> GroupNode | ArrayNode:
        whole = path if path.startswith("/") else f"{self.name}/{path}"
        try:
            found = self._box.find(whole)
        except container.ContainerError as e:
            raise KeyError(path) from e
        return (GroupNode if isinstance(found, container.Group) else ArrayNode)(self._box, whole.strip("/"), found)

    def groups(self) -> list[str]:
        return [k for k in self.keys() if isinstance(self[k], GroupNode)]

    def datasets(self) -> list[str]:
        return [k for k in self.keys() if isinstance(self[k], ArrayNode)]


class File(GroupNode):
    """A file by its path, of which only what is asked for is read, or by its bytes."""

    def __init__(self, source: str | bytes):
        box = container.Container(source) if isinstance(source, bytes) else opened(source)
        super().__init__(box, "", box.object(box.root))


class Writer:
    """Datasets and attributes one by one; the file is made when it is asked for."""

    def __init__(self) -> None:
        self._arrays: dict[str, np.ndarray] = {}
        self._how: dict[str, dict] = {"attributes": {}, "chunks": {}, "most": {}, "fill_times": {}, "links": {}}
        self._compact: list[str] = []
        self._filters: Sequence[tuple[str, int]] = ()

    def create_dataset(self, path: str, data: object, chunks: Sequence[int] | None = None, maxshape: Sequence[int | None] | None = None, filters: Sequence[tuple[str, int]] = (), compact: bool = False, fill_time: str | None = None) -> Writer:
        path = path.strip("/")
        if path in self._arrays:
            raise container.ContainerError(f"{path} is there")
        self._arrays[path] = np.asarray(data)
        for name, value in (("chunks", chunks), ("most", maxshape), ("fill_times", fill_time)):
            if value is not None:
                self._how[name][path] = value
        if filters:
            if self._filters and list(filters) != list(self._filters):
                raise container.ContainerError("one file has one chain of filters")
            self._filters = filters
        if compact:
            self._compact.append(path)
        return self

    def set_attribute(self, path: str, name: str, value: object) -> Writer:
        self._how["attributes"].setdefault(path.strip("/"), {})[name] = value
        return self

    def link(self, path: str, to: str | tuple[str, str]) -> Writer:
        self._how["links"][path.strip("/")] = to
        return self

    def to_bytes(self) -> bytes:
        return container.write(self._arrays, filters=self._filters, compact=self._compact, **self._how)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())


def attribute(attrs: Mapping[str, object], name: str, kind: type) -> object:
    """An attribute as float, int, str or a list of str; KeyError without it, TypeError if it is another thing."""
    value = attrs[name]
    if kind is float and isinstance(value, int | float):
        return float(value)
    if kind is int and isinstance(value, int):
        return value
    if kind is str and isinstance(value, str):
        return value
    if kind is list:
        if isinstance(value, str):
            return [value]
        if isinstance(value, list) and all(isinstance(v, str) for v in value):
            return value
    raise TypeError(f"{name} is no {kind.__name__}")
