"""The per-page helper of the one Python stage: HTML to flat node columns, Arrow in and out.

The module needs nothing from the rest of the package, so it can travel to executors by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

# fixed values: elements without content, elements whose text is not page text, and
# attributes holding a blank-separated list
VOID_TAGS = frozenset([
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
])
SILENT_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
CHROME_TAGS = frozenset(["nav", "header", "footer"])
LIST_ATTRS = frozenset(["class", "rel", "rev", "accesskey", "dropzone"])

NODES_PER_BATCH = 40_000

_NODE_TYPE = pa.struct([
    ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("in_chrome", pa.bool_()), ("last_child", pa.bool_()),
    ("t_lo", pa.int32()), ("t_hi", pa.int32()),
])


class Shredder(HTMLParser):
    """Appends the nodes and texts of successive pages to flat columns.

    Tree rules: void elements never nest; an unmatched end tag is ignored; an end tag closes
    everything up to the nearest open element of its name; nothing is closed implicitly.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.start_batch()

    def start_batch(self) -> None:
        self.last: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.chrome: list[bool] = []
        self.last_child: list[bool] = []
        self.t_lo: list[int] = []
        self.t_hi: list[int] = []
        self.attr_names: list[str] = []
        self.attr_values: list[str] = []
        self.attr_ends: list[int] = [0]
        self.texts: list[str] = []
        self.node_ends: list[int] = [0]
        self.text_ends: list[int] = [0]

    def add_page(self, html: str | None) -> None:
        first_node, first_text = len(self.tag), len(self.texts)
        self._first, self._first_text = first_node, first_text
        self._open: list[int] = []
        self._open_tags: dict[str, int] = {}
        self._silent = 0
        self._words: list[str] = []
        self._newest_child: dict[int, int] = {}
        if html:
            self.reset()
            try:
                self.feed(html)
                self.close()
                self._flush()
                while self._open:
                    self._pop()
            except AssertionError:  # markup the parser rejects: the page yields nothing
                self._drop_page(first_node, first_text)
                self._newest_child = {}
        for node in self._newest_child.values():
            self.last_child[node] = True
        self.node_ends.append(len(self.tag))
        self.text_ends.append(len(self.texts))

    def _drop_page(self, first_node: int, first_text: int) -> None:
        attrs = self.attr_ends[first_node]
        for column in (self.last, self.parent, self.depth, self.tag, self.chrome,
                       self.last_child, self.t_lo, self.t_hi):
            del column[first_node:]
        del self.attr_names[attrs:], self.attr_values[attrs:], self.attr_ends[first_node + 1:]
        del self.texts[first_text:]

    def _flush(self) -> None:
        if self._words:
            if not self._silent:
                text = "".join(self._words).strip()
                if text:
                    self.texts.append(text)
            self._words.clear()

    def _pop(self) -> str:
        node = self._open.pop()
        tag = self.tag[node]
        self.last[node] = len(self.tag) - 1 - self._first
        self.t_hi[node] = len(self.texts) - self._first_text
        self._open_tags[tag] -= 1
        if tag in SILENT_TAGS:
            self._silent -= 1
        return tag

    def _push(self, tag: str, attrs: list) -> None:
        self._flush()
        node = len(self.tag)
        parent = self._open[-1] if self._open else -1
        here = len(self.texts) - self._first_text
        self.last.append(node - self._first)
        self.parent.append(parent - self._first if parent >= 0 else -1)
        self.depth.append(len(self._open))
        self.tag.append(tag)
        self.chrome.append(parent >= 0 and (self.chrome[parent] or self.tag[parent] in CHROME_TAGS))
        self.last_child.append(False)
        self.t_lo.append(here)
        self.t_hi.append(here)
        self._newest_child[parent] = node
        for name, value in dict(attrs).items():
            value = value or ""
            self.attr_names.append(name)
            self.attr_values.append(" ".join(value.split()) if name in LIST_ATTRS else value)
        self.attr_ends.append(len(self.attr_names))
        self._open.append(node)
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1
        if tag in SILENT_TAGS:
            self._silent += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._push(tag, attrs)
        if tag in VOID_TAGS:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._push(tag, attrs)
        self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self._open_tags.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self._words.append(data)

    def _split_text(self, data: str) -> None:
        self._flush()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    handle_comment = handle_decl = handle_pi = _split_text

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self._words.append(data[6:])
            self._flush()

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        starts = self.node_ends
        pre = [i for a, b in zip(starts, starts[1:]) for i in range(b - a)]
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_ends, pa.int32()),
            pa.array(self.attr_names, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        ints = (pre, self.last, self.parent, self.depth)
        columns = [pa.array(c, pa.int32()) for c in ints]
        columns += [pa.array(self.tag, pa.string()), attrs,
                    pa.array(self.chrome, pa.bool_()), pa.array(self.last_child, pa.bool_()),
                    pa.array(self.t_lo, pa.int32()), pa.array(self.t_hi, pa.int32())]
        struct = pa.StructArray.from_arrays(columns, fields=list(_NODE_TYPE))
        texts = pa.ListArray.from_arrays(
            pa.array(self.text_ends, pa.int32()), pa.array(self.texts, pa.string())
        )
        return texts, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)


def shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shredder = Shredder()
    for batch in batches:
        at = batch.schema.get_field_index("html")
        kept = [i for i in range(batch.num_columns) if i != at]
        names = [batch.schema.names[i] for i in kept] + ["texts", "nodes"]
        html, start = batch.column(at), 0
        for row in range(batch.num_rows):
            shredder.add_page(html[row].as_py())
            done = row + 1
            if len(shredder.tag) >= NODES_PER_BATCH or done == batch.num_rows:
                part = [batch.column(i).slice(start, done - start) for i in kept]
                yield pa.RecordBatch.from_arrays([*part, *shredder.arrays()], names=names)
                shredder.start_batch()
                start = done
