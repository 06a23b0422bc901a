"""Pages, a few at a time."""

import pyarrow as pa

from loomline.operators import html


class Batches:
    """Stands for pages: gives the function that a task runs."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_pages_are_parsed_a_few_at_a_time(spark):
    texts = [None if i % 50 == 0 else f"<p>t{i}<img src=i{i}.png>" for i in range(300)]
    batch = pa.record_batch([pa.array(range(300)), pa.array(["http://a.org/"] * 300), pa.array(texts)], names=["page_id", "url", "html"])
    made = list(html.extract(Batches())([batch]))
    assert [b.num_rows for b in made] == [64, 64, 64, 64, 44]
    got = {i: [n["text"] or n["src"] for n in nodes] for b in made for i, nodes in zip(b["page_id"].to_pylist(), b["nodes"].to_pylist(), strict=True)}
    assert got == {i: [] if i % 50 == 0 else [f"t{i}", f"http://a.org/i{i}.png"] for i in range(300)}
