"""Keyword-stuffed and link-list pages, told by how their terms recur.

A text is read as a row of terms: words, and marks such as a link, a tag or a price. Around each
term a window is laid, and three things are measured in it.

Autocorrelation by position: at which of the lags 1 to 40 does the row of terms agree with itself.
Of the content words of strung keywords nearly all agree at some lag, and most at one up to 12.
Recurrence gaps: a content word lies between its last and its next occurrence, at any distance. In
prose words come in bursts, so the two gaps are unlike; where words are strung from a stock they are
much alike, however large the stock. Sentences that repeat come back in whole phrases with function
words in them, or hold more function words, and are let off for either.
Function words: a long row of distinct nouns or marks that holds hardly any is a list. Words are
listed for four languages; a text in another one has none of them, so it is a list only where its
words do not stand in sentences, or come back.

The characters of windows of any kind are summed, and a page is stuffed if they are more than half
of its characters. Log lines, tables of figures, sequences and commands are told by their form and
not counted, unless their words are the keywords of a list.

A text of fewer than LEAST_TERMS terms does not fill a window: a short sentence may well hold no
function word. It is judged as a whole, by what makes a list: links or tags that follow each other,
entries between separators, or keywords that come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of four languages. Words that tie nouns together (of, de, du,
# del, des...) are left out: names of goods hold them as often as sentences do.
FUNCTION_WORDS = frozenset(
    """
    a an the and or but to in on at for from with without by as is are was were be been it its this that these those
    which who what when where while because before after than then if not no only both each all more most some any until
    has have had do does did will would can could should may i we you they he she them their our your my
    der die das den dem ein eine einen einem einer und oder aber von vom zu zum zur mit ohne in im an am auf für bei
    nach vor aus wie wenn weil sofern bevor nicht nur noch ist sind war wird werden wir ich sie es als alle jede jedes jeden
    le la les l un une et ou mais à au aux en dans par pour sans sur est sont ne pas que qui se ce cette ces nous
    il elle je si quand chaque toutes tous plus
    el los las lo una unos unas y o pero con sin por para al que se no es son su sus este esta cuando cada todas todos más
    """.split()
)
HALF_WINDOW = 12
LAG = 40
LEAST_FUNCTION_SHARE = 0.13
MOST_FUNCTION_SHARE = 0.38
#: A text with a smaller share of function words than this may be in an unlisted language.
OWN_FUNCTION_SHARE = 0.2
LEAST_RECURRING = 0.85
CLOSE_LAG = 12
LEAST_CLOSE = 0.6
MOST_PHRASES = 0.4
PHRASE = 5
#: Of the content words of a window, how many must lie between gaps that are alike, and how alike these are.
LEAST_REGULAR = 0.5
MOST_UNLIKE = 0.34
#: Of the words and marks of a window, how many must be words in sentences for prose of an unlisted language, and how many may agree at some lag.
LEAST_IN_SENTENCES = 0.8
MOST_AGREEING = 0.6
LEAST_SENTENCE = 4
#: Rows of a table under one name of several words that make it a keyword.
KEYWORD_ROWS = 4
ENDS_OF_ROWS = frozenset("0123456789.,% \t")
LEAST_TERMS = 20
# For texts of fewer terms: two links or tags make a list; of other entries, and of returns of a keyword, it takes four.
LEAST_LINKS = 2
LEAST_ENTRIES = 4
MOST_ENTRY_TERMS = 4


WORD, FIGURE, MARK = 0, 1, 2
NEVER = 1 << 40
#: Terms a worker remembers; beyond it the book starts anew, between texts.
KEPT_TERMS = 1_000_000
#: Terms that are judged at once.
BLOCK_TERMS = 100_000


class Reader:
    """Cuts texts to terms; remembers of each term its number, its kind and whether it is a function word."""

    def __init__(self):
        import regex

        self.term = regex.compile(
            r"(</?[a-z]+(?:\s[^<>]*)?/?>|(?:https?:)?//[^\s|\])>\"<]+|www\.[^\s|\])>\"<]+"  # link
            r"|\#[\p{L}\d_-]+"  # tag
            r"|[★☆]+|\d[\d.,]*\s?[€$£]|\b[A-Z]{2,4}-\d+"  # stars, price, number of an article
            r"|\d[\d.,:]*%?"  # figure
            r"|\p{L}+(?:-\p{L}+)*)"  # word
        )
        self.form = regex.compile(
            r"\W*(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d:\d\d\b.*"  # log line
            r"|\s*[ACGTUNacgtun]{15,}\s*"  # sequence
            r"|\s*>[^\s>]\S*(?:\s\S+)?\s*"  # its heading
            r"|\s*\$\s(?=.*(?:(?:^|\s)--?\w|[/=<>|&]|\w\.\w)).*",  # command, with an option, a path or an assignment
            regex.S,
        )
        self.row = regex.compile(r"([^,;|\t]{1,40})(?:\s*[,;|\t]\s*[\d.,%]+){2,}\s*", regex.S)  # row of a table
        self.sentences = regex.compile(r"[\p{Lu}\p{Lo}][^.!?…。！？]*+(?:\.(?=\w)[^.!?…。！？]*+)*+[.!?…。！？]", regex.S)
        self.marks = regex.compile(r"https?:|www\.|[<>★☆#€$£|•·»›\t;]|\(\d+\)|\s[*/]\s")
        self.figure = regex.compile(r"\d[\d.,:]*%?")
        self.breaks = regex.compile(r"(\r\n|\r|\n)")
        self.separators = regex.compile(r"[\r\n;|•·»›、，；]|,(?!\d)|\s[-–*/>]\s")
        self.sentence = regex.compile(r"[\p{L}\p{N})\"][.!?…](?:\s|$)|[。！？]")
        self.known: dict[str, tuple[int, int, bool]] = {}
        self.numbers: dict[str, int] = {}

    def _look(self, term: str) -> tuple[int, int, bool]:
        if term[0].isalpha() and not term.startswith(("www.", "http:", "https:")) and not term[-1].isdigit():
            kind, name = WORD, term.lower()
        elif self.figure.fullmatch(term):
            kind, name = FIGURE, "0"
        else:
            kind, name = MARK, term[0] if term[0] in "<#★☆" else "/"
        found = self.numbers.setdefault(name, len(self.numbers)), kind, kind == WORD and name in FUNCTION_WORDS
        if len(term) <= 40:
            self.known[term] = found
        return found

    def read(self, text: str) -> tuple[list[tuple[int, int, bool]], list[int]]:
        """The terms outside lines of known form: (number, kind, function word) and characters up to the next one."""
        looked: list[tuple[int, int, bool]] = []
        sizes: list[int] = []
        pieces = self.breaks.split(text)
        known = self.known
        for i in self._lines(pieces):
            parts = self.term.split(pieces[i])
            if len(parts) == 1:
                continue
            sizes.append(len(parts[0]) + len(parts[1]) + len(parts[2]))
            sizes += [len(a) + len(b) for a, b in zip(parts[3::2], parts[4::2])]
            if i + 1 < len(pieces):
                sizes[-1] += len(pieces[i + 1])
            looked += [known.get(t) or self._look(t) for t in parts[1::2]]
        return looked, sizes

    def _lines(self, pieces: list[str]) -> list[int]:
        """Which lines are read: those of no known form, and rows of figures under a name of several
        words, without a digit, that comes back as a name.
        """
        kept: list[tuple[int, str]] = []
        names: dict[str, int] = {}
        for i in range(0, len(pieces), 2):
            body = pieces[i]
            if not body or self.form.fullmatch(body):
                continue
            name = ""
            if body[-1] in ENDS_OF_ROWS and (m := self.row.fullmatch(body)):
                name = m[1]
                if " " not in name.strip() or any(c.isdigit() for c in name):
                    continue
                names[name] = names.get(name, 0) + 1
            kept.append((i, name))
        return [i for i, name in kept if not name or names[name] >= KEYWORD_ROWS]

    def in_sentences(self, text: str) -> list[bool]:
        """For each term that ``read`` gives, whether it stands in a sentence.

        A sentence begins with a capital, or a letter of a script that has none, ends with a mark of
        its own, has LEAST_SENTENCE words at least, more than four for each comma or line, and no mark of a list.
        """
        spans = []
        for m in self.sentences.finditer(text):
            # where words are written together, two letters stand for one
            words = sum(max(1, len(t) // 2 if t[0].lower() == t[0].upper() else 1) for t in self.term.findall(m[0]) if t[0].isalpha())
            if not self.marks.search(m[0]) and words >= LEAST_SENTENCE and words > 4 * len(self.separators.findall(m[0])):
                spans.append(m.span())
        out: list[bool] = []
        pieces = self.breaks.split(text)
        kept = set(self._lines(pieces))
        start = at = 0
        for i, body in enumerate(pieces):
            if i in kept:
                for m in self.term.finditer(body):
                    while at < len(spans) and spans[at][1] <= start + m.start():
                        at += 1
                    out.append(at < len(spans) and spans[at][0] <= start + m.start())
            start += len(body)
        return out

    def entries(self, text: str) -> int:
        """How many entries a short text lists between separators; 0 if any of it is no short entry or has a known form."""
        if self.sentence.search(text) or any(b and (self.form.fullmatch(b) or self.row.fullmatch(b)) for b in self.breaks.split(text)[::2]):
            return 0
        found = 0
        for piece in self.separators.split(text):
            terms = self.term.findall(piece)
            if not terms:
                continue
            if len(terms) > MOST_ENTRY_TERMS or all(self.figure.fullmatch(t) for t in terms) or "=" in piece or ":" in piece:
                return 0
            found += 1
        return found

    def forget(self) -> None:
        """Starts the book anew if it is full; between blocks of texts only, as numbers change."""
        if len(self.known) > KEPT_TERMS or len(self.numbers) > KEPT_TERMS:
            self.known.clear()
            self.numbers.clear()


def _gaps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each place to the last and to the next one of the same code; NEVER where there is none."""
    order = np.argsort(codes, kind="stable")
    gap = np.where(codes[order][1:] == codes[order][:-1], np.diff(order), NEVER)
    last, following = np.full(len(codes), NEVER), np.full(len(codes), NEVER)
    last[order[1:]] = gap
    following[order[:-1]] = gap
    return last, following


def _alike(last: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Whether both gaps are there and much the same."""
    return (last < NEVER) & (following < NEVER) & (np.abs(last - following) <= MOST_UNLIKE * (last + following))


def _phrases(code: np.ndarray, func: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a term lies in a phrase with a function word that comes back in its text."""
    out = np.zeros(len(code), dtype=bool)
    n = len(code) - PHRASE + 1
    if n < 1:
        return out
    h = (owner[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    f = np.zeros(n, dtype=np.int64)
    for i in range(PHRASE):
        h = (h ^ code[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        f += func[i : i + n]
    usable = np.flatnonzero((f > 0) & (owner[:n] == owner[PHRASE - 1 :]))
    _, back, count = np.unique(h[usable], return_inverse=True, return_counts=True)
    again = usable[count[back] > 1]
    for i in range(PHRASE):
        out[again + i] = True
    return out


def stuffed_terms(terms: np.ndarray, owner: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Whether each term lies in a stuffed window. terms: (number, kind, function word); owner: its text,
    in order; prose: it stands in a sentence of a text without function words.
    """
    code, kind, func = terms[:, 0], terms[:, 1], terms[:, 2].astype(bool)
    at = np.arange(len(code))
    start = np.searchsorted(owner, owner, "left")
    stop = np.searchsorted(owner, owner, "right")
    low, high = np.maximum(at - HALF_WINDOW, start), np.minimum(at + HALF_WINDOW + 1, stop)

    def spread(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[high] - total[low]

    content = (kind == WORD) & ~func
    own = code + owner * (int(code.max(initial=0)) + 1)
    words = np.maximum(spread(content), 1)
    functional = spread(func) / np.maximum(spread(kind != FIGURE), 1)
    last, following = _gaps(own)
    nearest = np.minimum(last, following)  # the least lag at which the row agrees with itself here
    recurring = spread((nearest <= LAG) & content) / words
    close = spread((nearest <= CLOSE_LAG) & content) / words
    phrases = spread(_phrases(code, func | prose, owner)) / (high - low)
    phrased = (phrases >= MOST_PHRASES) & (close < LEAST_CLOSE)
    told = spread(prose & (kind == WORD)) >= LEAST_IN_SENTENCES * np.maximum(spread(kind != FIGURE), 1)
    listed = (functional < LEAST_FUNCTION_SHARE) & ~(told & ((recurring < MOST_AGREEING) | phrased))
    regular = spread(_alike(last, following) & content) / words
    strung = (regular >= LEAST_REGULAR) & (functional < MOST_FUNCTION_SHARE) & (phrases < MOST_PHRASES)
    return listed | strung | ((recurring >= LEAST_RECURRING) & (functional < MOST_FUNCTION_SHARE) & ((phrases < MOST_PHRASES) | (close >= LEAST_CLOSE)))


def short_share(text: str, looked: list[tuple[int, int, bool]], sizes: list[int], reader: Reader) -> float:
    """Share of a text of fewer than LEAST_TERMS terms that is a list or repeated keywords."""
    n = len(looked)
    whole = sum(sizes) / len(text)
    content = [code for code, kind, func in looked if kind == WORD and not func]
    worded = max(sum(kind != FIGURE for _, kind, _ in looked), 1)
    functional = sum(func for *_, func in looked) / worded
    if len(content) >= LEAST_ENTRIES * len(set(content)) > 0 and functional < MOST_FUNCTION_SHARE:
        return whole
    if functional < LEAST_FUNCTION_SHARE and reader.entries(text) >= LEAST_ENTRIES:
        return whole
    # else the longest stretch of links or tags, with the words that name them
    best = 0
    html, links = reader.numbers.get("<"), {reader.numbers.get("/"), reader.numbers.get("#")}
    for i in range(n):
        marks = elements = functions = worded = inside = 0
        for j in range(i, n):
            code, kind, func = looked[j]
            inside += sizes[j]
            functions += func
            worded += kind != FIGURE
            if kind == MARK:
                marks += 1
                elements += 1 if code == html else 2 if code in links else 0
                if elements >= 2 * LEAST_LINKS and 3 * marks >= j - i + 1 and functions < LEAST_FUNCTION_SHARE * worded:
                    best = max(best, inside)
    return best / len(text)


def stuffed_shares(texts: list[str | None], reader: Reader) -> np.ndarray:
    """Share of each text's characters that lie in stuffed windows; 0 for null and empty texts. Texts of
    fewer than LEAST_TERMS terms are judged by ``short_share``.
    """
    out = np.zeros(len(texts))
    terms: list[tuple[int, int, bool]] = []
    sizes: list[int] = []
    owners: list[int] = []
    counts: list[int] = []

    def judge() -> None:
        if terms:
            owner = np.repeat(np.array(owners), np.array(counts))
            rows = np.array(terms, dtype=np.int64)
            first = np.cumsum(counts) - counts
            functional = np.add.reduceat(rows[:, 2], first) < OWN_FUNCTION_SHARE * np.add.reduceat(rows[:, 1] != FIGURE, first)
            prose = np.zeros(len(rows), dtype=bool)
            for k in np.flatnonzero(functional):
                prose[first[k] : first[k] + counts[k]] = reader.in_sentences(texts[owners[k]])
            inside = stuffed_terms(rows, owner, prose)
            stuffed = np.bincount(owner, weights=np.array(sizes) * inside, minlength=len(texts))
            for i in owners:
                out[i] = stuffed[i] / len(texts[i])
        for x in (terms, sizes, owners, counts):
            x.clear()
        reader.forget()

    for i, text in enumerate(texts):
        looked, size = reader.read(text) if text else ([], [])
        if len(looked) >= LEAST_TERMS:
            terms += looked
            sizes += size
            owners.append(i)
            counts.append(len(looked))
        elif looked:
            out[i] = short_share(text, looked, size, reader)
        if len(terms) >= BLOCK_TERMS:
            judge()
    judge()
    return out


def page_shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stuffed_share) of every row; a narrow map over the scan, over whole texts.

    Null, empty and blank texts have share 0. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            shares = stuffed_shares(batch.column(1).to_pylist(), reader)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=[id_col, "stuffed_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, stuffed_share double")


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the rows more than half of whose characters are stuffed."""
    return page_shares(docs, id_col, text_col).where("stuffed_share > 0.5").select(id_col)
