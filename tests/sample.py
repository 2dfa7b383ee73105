"""A small book with one of each defect, as rows of the input contract."""

SPAN = ["book_id", "page", "block_seq", "line_seq", "span_seq", "text", "size", "font", "flags", "x0", "y0", "x1", "y1", "dir_x", "dir_y",
        "l_x0", "l_y0", "l_x1", "l_y1", "b_x0", "b_y0", "b_x1", "b_y1"]
SPAN_TYPES = (
    "book_id string, page int, block_seq int, line_seq int, span_seq int, text string, size double, font string, flags int, x0 double, y0 double, x1 double, y1 double, "
    "dir_x double, dir_y double, l_x0 double, l_y0 double, l_x1 double, l_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double"
)


class Book:
    def __init__(self, book_id="b"):
        self.book_id, self.rows, self.block = book_id, [], {}

    def add(self, page, lines, x0=40.0, top=100.0, size=10.0, flags=0, width=None, pitch=14.0, font="Serif", dir_x=1.0):
        """One block: lines are strings or lists of (text, flags) spans."""
        b = self.block[page] = self.block.get(page, -1) + 1
        x0, top, size = float(x0), float(top), float(size)
        boxes = []
        for i, line in enumerate(lines):
            spans = line if isinstance(line, list) else [(line, flags)]
            x1 = x0 + (float(width) if width is not None else sum(len(t) for t, _ in spans) * size * 0.5)
            boxes.append((spans, x0, top + i * pitch, x1, top + i * pitch + size * 1.2))
        box = (min(x[1] for x in boxes), boxes[0][2], max(x[3] for x in boxes), boxes[-1][4])
        for i, (spans, a, y, c, z) in enumerate(boxes):
            for s, (text, f) in enumerate(spans):
                self.rows.append((self.book_id, page, b, i, s, text, size, font, f, a, y, c, z, dir_x, 0.0, a, y, c, z, *box))
        return b


def sample() -> Book:
    k = Book("sample")
    long = "This sentence of the body fills its line from the left edge to the right"
    k.add(0, ["The Salt Road"], x0=120, top=120, size=24, flags=16)
    k.add(0, ["Ada Ferryman"], x0=150, top=180, size=12, flags=2)
    for page in range(1, 6):
        k.add(page, ["An Example Press"], top=22, size=7)
        k.add(page, [f"- {page + 1} -"], x0=40, top=565, size=8)
    k.add(1, ["Contents"], top=80, size=16)
    for n in range(5):
        k.add(1, [f"Part number {n} . . . . . . . {n + 3}"], top=120 + 22 * n)
    k.add(2, ["Chapter 1 - Departure"], top=80, size=16, flags=16)
    k.add(2, [long, "and goes on with inva-", "riably ﬁne print."], top=110, width=300)
    k.add(2, ["1.1 The harbour"], top=180, size=12, flags=16)
    k.add(2, ["The boat left at dawn and the whole crew was"], top=210, width=300)
    k.add(3, ["Chapter 1 - Departure"], top=42, size=7)
    k.add(3, ["still asleep when the storm came."], top=80, width=300)
    k.add(3, ["Chapter 2 - Columns"], top=180, size=16, flags=16)
    k.add(4, ["Chapter 2 - Columns"], top=42, size=7)
    for n in range(4):
        k.add(4, [f"Left column text {n}."], x0=40, top=80 + 40 * n, size=9, width=155)
        k.add(4, [f"Right column text {n}."], x0=225, top=80 + 40 * n, size=9, width=155)
    k.add(5, ["Chapter 3 - The end"], top=80, size=16, flags=16)
    for n in range(3):
        k.add(5, [f"- item number {n}"], top=120 + 20 * n)
    k.add(5, [[("A plain start and a ", 0), ("bold end", 16), (".", 0)]], top=220, width=300)
    k.add(5, ["1 A note at the foot."], top=480, size=7)
    return k


def frames(spark, book: Book, images=(), metadata=None, pages=6, path="/in/the_salt_road.pdf"):
    from leafmill.plans.pipeline import Inputs

    return Inputs(
        spark.createDataFrame(book.rows, SPAN_TYPES),
        spark.createDataFrame(list(images), "book_id string, page int, block_seq int, x0 double, y0 double, x1 double, y1 double, image binary, ext string"),
        spark.createDataFrame([(book.book_id, p, 420.0, 595.0) for p in range(pages)], "book_id string, page int, width double, height double"),
        spark.createDataFrame([(book.book_id, path, pages, metadata or {})], "book_id string, path string, page_count int, metadata map<string,string>"),
    )
