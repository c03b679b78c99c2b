"""Plain markup cut by an expression gives what the parser gives."""

import random
from html.parser import HTMLParser

from millrace.sources import html as H

PIECES = ["<p>", "</p>", '<a href="https://x/?a=1&amp;b=2">', '<a href="https://y/?copy=1&copy=2">', "</a>", "a & b", "&lt;", "&amp;lt; c", "<br>", "<br/>", "<BR>", "<script>a<b</script>", "<!-- c -->", "<title>x</title>", "<title>q<p>", "<", ">", "\n", "</x", "<p id='a'>", '<p  id="a">', '<p id="a" id="b">', "\x00", "&am", "é"]


class Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen, self.plain = [], True

    def feed(self, data):
        self.plain = False
        super().feed(data)

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, attrs))

    def handle_endtag(self, tag):
        self.seen.append(("/", tag))

    def handle_data(self, data):
        self.seen.append(("text", data))


def test_events_are_those_of_the_parser():
    rng, plain = random.Random(7), 0
    for _ in range(5_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6)))
        own, whole = H.fed(Events(), text), Events()
        whole.feed(text)
        whole.close()
        assert own.seen == whole.seen, text
        plain += own.plain
    assert 500 < plain < 5_000
