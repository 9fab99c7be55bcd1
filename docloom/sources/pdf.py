"""Page counts and single pages of simple PDF files, on the standard library alone.

It follows the page tree of files with plain or compressed objects. Pages of an encrypted file keep its
object numbers and its key's entries, so that a reader can still decrypt them. What can't be followed
(a tree in encrypted streams, damage) is an error, which all modes but ``split`` tolerate.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R\b")


#: Ends a page's own object until its parent is known.
PARENT = b" /Parent >>"


class SplitError(ValueError):
    pass


class Pdf:
    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise SplitError("The file is not a PDF.")
        self.content = content
        trailer = content[content.rfind(b"trailer") :] if b"trailer" in content else b""
        encrypt, ident = re.search(rb"/Encrypt\s+(\d+)\s+(\d+)\s+R", trailer), re.search(rb"/ID\s*\[.*?\]", trailer, re.S)
        self.encrypt = int(encrypt[1]) if encrypt else None
        self.trailer = b" ".join(x[0] for x in (encrypt, ident) if x)
        self.objects = {int(m[1]): m[3].strip() for m in OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self.unpack(body)
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", roots[-1]) if roots else None
        if not top:
            raise SplitError("The file's page tree can't be read.")
        self.root = int(top[1])
        self.pages: list[int] = []
        self.walk(self.root, set())

    def unpack(self, body: bytes) -> None:
        head, _, data = body.partition(b"stream")
        data = data.lstrip(b"\r\n").rsplit(b"endstream", 1)[0]
        n, first = re.search(rb"/N\s+(\d+)", head), re.search(rb"/First\s+(\d+)", head)
        if not n or not first:
            return
        try:
            raw = zlib.decompressobj().decompress(data) if b"FlateDecode" in head else data
        except zlib.error:
            return
        numbers = list(map(int, raw[: int(first[1])].split()))[: 2 * int(n[1])]
        places = [*numbers[1::2], len(raw) - int(first[1])]
        for k, number in enumerate(numbers[::2]):
            self.objects.setdefault(number, raw[int(first[1]) + places[k] : int(first[1]) + places[k + 1]].strip())

    def walk(self, number: int, seen: set[int]) -> None:
        body = self.objects.get(number)
        if body is None or number in seen:
            raise SplitError("The file's page tree can't be read.")
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for kid in REF.findall(kids[1]):
                self.walk(int(kid), seen)
        else:
            self.pages.append(number)

    def page(self, index: int) -> bytes:
        """Page ``index`` (from 1) as a file of its own: its objects, in a new tree of one page."""
        if not 1 <= index <= len(self.pages):
            raise SplitError(f"The file has no page {index}.")
        own = self.pages[index - 1]
        inherited = self.inherited(own)
        keep, todo = {}, [own]
        while todo:
            number = todo.pop()
            if number in keep or number not in self.objects:
                continue
            body = self.objects[number]
            if number == own:
                body = re.sub(rb"/Parent\s+\d+\s+\d+\s+R", b"", body)
                body = body[: body.rindex(b">>")] + inherited + PARENT
            elif re.search(rb"/Type\s*/Pages?\b", body):
                continue
            keep[number] = body
            todo += [int(x) for x in REF.findall(body.split(b"stream")[0])]
        root, top = 1, 2
        shift = {old: k + 3 for k, old in enumerate(sorted(keep))}
        if self.encrypt is not None:  # the keys of strings and streams depend on the objects' numbers
            keep |= {self.encrypt: self.objects.get(self.encrypt, b"null")}
            root, top = max(self.objects) + 1, max(self.objects) + 2
            shift = {old: old for old in keep}
        parent = b" /Parent %d 0 R >>" % top
        out, places = bytearray(b"%PDF-1.5\n"), []

        def add(number: int, body: bytes) -> None:
            places.append((number, len(out)))
            out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

        add(root, b"<< /Type /Catalog /Pages %d 0 R >>" % top)
        add(top, b"<< /Type /Pages /Kids [%d 0 R] /Count 1 >>" % shift[own])
        for old in sorted(keep):
            head, mark, tail = keep[old].partition(b"stream")
            fixed = REF.sub(lambda m: b"%d 0 R" % shift[int(m[1])] if int(m[1]) in shift else b"null", head.removesuffix(PARENT) if old == own else head)
            add(shift[old], (fixed + parent if old == own else fixed) + mark + tail)
        start = len(out)
        table = dict(places)
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (max(table) + 1))
        for number in range(1, max(table) + 1):
            out.extend(b"%010d 00000 n \n" % table[number] if number in table else b"0000000000 65535 f \n")
        out.extend(b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (max(table) + 1, root, self.trailer if self.encrypt is not None else b"", start))
        return bytes(out)

    def inherited(self, number: int) -> bytes:
        """Page attributes that stand further up in the tree."""
        out, own, body, seen = b"", self.objects[number], self.objects[number], set()
        while (up := re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)) and int(up[1]) not in seen:
            seen.add(int(up[1]))
            body = self.objects.get(int(up[1]), b"")
            for key in (b"/MediaBox", b"/Resources", b"/Rotate", b"/CropBox"):
                if key not in own and key not in out and (found := re.search(re.escape(key) + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R|-?\d+|<<.*?>>)", body, re.S)):
                    out += b" " + key + b" " + found[1]
        return out


def simple_pdf(sizes: list[tuple[int, int]]) -> bytes:
    """A file of empty pages of the given sizes, for tests and examples."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (k + 3) for k in range(len(sizes))), len(sizes))]
    bodies += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] >>" % s for s in sizes]
    for k, body in enumerate(bodies):
        places.append(len(out))
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (k + 1, body))
    start = len(out)
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))
    return bytes(out)
