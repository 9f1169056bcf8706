"""Problem 2: the release within its page, by tree scoring.

The text of a page is read as a two-level tree: lines (link-like, prose,
heading) are leaves, blocks of lines of any kind between blank lines are
containers, the page is the root.  Every prose line passes points for its length
and its commas to its container; a container's points are discounted by its
link density, the share of its characters that stands in link-like lines.  The
prose of every container that has the points of a paragraph left is the release,
with the headings that it opens or goes on around; a sentence among many links
is furniture as they are.  All other lines that aren't blank belong to the site.
A container is measured by itself and not against the best one, so that a last
paragraph counts as much after a long release as after a short one.

Plain text has no anchors.  ``link_density`` of a line therefore comes from
what links and furniture look like in text: menu labels, separators, symbols
between labels, headline case without a full stop, addresses and the standing
phrases below.
"""

from __future__ import annotations

import re

#: Words that menus of public offices are made of.
MENU = (
    r"(?:home|menu|search|careers?|contact(?: us)?|divisions|newsroom|opinions|publications|about(?: the office| us)?|victim services|open government|events calendar|events"
    r"|file a complaint|complaints|espa[nñ]ol|english|media|news|news releases|press releases|media advisories|resources|services|login|sign in|sitemap|site map|faqs?|help|topics|privacy(?: policy)?|terms(?: of use)?|accessibility(?: statement)?)"
)
_SEP = r"(?:\s*[|·>/»•*+‹›]\s*|\s+[-–—]\s+|\s{2,})"
#: How a line of the site begins (or what it wholly is).
STARTS = re.compile(
    rf"[\s>*+•·|»\-–—]*(?:{MENU}(?:{_SEP}{MENU})*[\s|·>»]*$"
    r"|(?:skip|jump) (?:to\b|navigation)|©|\(c\)\s|copyright\b|share(?: this| on|\b\s*(?:$|email|print|:))|share this story|e?mail\s+print\b|print this page|send to a friend|listen to this|back to top|return to top|top of page"
    r"|follow us|sign up for|subscribe\b|get .{1,40} (?:news|alerts|updates) by e?mail|related (?:news|stories|posts|articles)|recent (?:posts|news)|more from\b|you may also|popular (?:now|this|today)|trending\b|most read|latest news"
    r"|for immediate release|press release$|news release$|media advisory$|release (?:no|number)\b|views:|last (?:updated|modified|reviewed)|posted (?:by|on)\b|published\b|updated:|by [\w ]{2,30} \| \d|by (?:communications|press|media) (?:staff|office)"
    r"|-\s*30\s*-\s*$|#\s*#\s*#\s*$|\*\s*\*\s*\*\s*$|\(end\)\s*$|end\s*$|media contacts?:|press (?:inquiries|contact)|contact:|for (?:media|press) inquiries|download\b.*\b(?:pdf|kb|mb)\b|download the\b|watch the\b.*\bhere\b|(?:read|see|learn|find out) more (?:about|on)\b|more (?:about|on) |story continues|continue reading"
    r"|(?:poll|survey): |tags?: |topics?: |filed under|categories: |(?:next|previous|prev)(?: article| story| release| post)?\s*[:>»]|(?:podcast|episode) \d+\s*:|(?:photo|image)s? (?:credit|courtesy|by)\b|(?:sponsored|advertisement)\b|noscript\b|please note: the\b"
    r"|(?:this|our) (?:website|site|page) (?:stores|uses)\b|we use cookies|cookies help|links to (?:other|external) |please enable|some features of this|(?:website|portal|site) maintenance\b|the information on \S+\.\S+ )",
    re.I,
)
#: Standing phrases anywhere in a line.
PHRASES = (
    "all rights reserved", "essential and analytics cookies", "accept all", "manage choices", "is provided for general purposes", "is provided for general information", "not legal advice", "not constitute legal advice",
    "may be reproduced if", "credited as the source", "do not imply endorsement", "is the chief legal office", "consumer desk, call", "complaint line; a translator", "translator is available", "your preferences at any time", "cookie policy",
    "every feature of this page", "to be switched on in your browser", "enter your address and press", "votes so far", "answers so far",
)
#: Inner headings that look like a label.
HEADS = re.compile(r"(?:background|key facts|next steps|how to get help|about the case|terms of the settlement|what the complaint says)\W*$", re.I)
TEASER = re.compile(r".{3,70}: (?:how|what|why|when|where) .{3,60}(?:…|\.\.\.)$", re.I)
DATELINE = re.compile(r"[A-Z][A-Z .'\-]{2,30}(?:,? [A-Z][\w.]*)? ?(?:--|[–—\-])(?:\s|$)")
BULLET = re.compile(r"(?:[•*\-–+>]|\d{1,2}[.)])\s+")
_SMALL = frozenset("a an and as at by for from in into of on or over the to with after against concerning involving vs".split())
LINK, PROSE, HEAD = 0, 1, 2
#: Points that a container of the release has at least: those of a short sentence, half of its container links.
LEAST_POINTS = 0.5


#: First letters that a line must have for STARTS to be worth trying.
_FIRST = frozenset(
    "hom men sea car con div new opi pub abo vic ope eve fil com esp eng med pre res ser log sig sit faq hel top pri ter acc ski jum cop sha ema e-m sen lis bac ret fol sub get rel rec mor you pop tre mos lat for vie las pos upd by 30 30- end dow wat rea sto pol sur tag cat nex pod epi pho ima spo adv nos thi our we coo lin ple som web por the ple lea fin see".split()
)
_LEAD = " \t>*+•·|»-–—#"


def ends(s: str) -> bool:
    """Whether a stripped line ends as a sentence, a clause before a list or a quotation does."""
    return s[-1] in "\"”" or s.rstrip("\"”’')]")[-1:] in (".", "!", "?", ":", ";")


def headline_case(s: str) -> bool:
    """Reads as a title: at least four words, nearly all of the longer ones capitalised, no full stop."""
    w = s.split()
    if len(w) < 4 or s[-1] in ".!?,\"”" or s[0] in "\"“":
        return False
    big = [x for x in w if x.lower() not in _SMALL and (x[0].isalpha() or x[0] == "$")]
    up = sum(x[0].isupper() or x[0] == "$" for x in big)
    return len(big) > 1 and up >= len(big) - (len(big) > 6)


def is_link(s: str) -> bool:
    """Whether a stripped line is furniture by its looks or words."""
    n = len(s)
    first = s.lstrip(_LEAD)[:3].lower()
    if (first.rstrip() in _FIRST or len(first) < 3 or first[0] in "©(") and STARTS.match(s):
        return not HEADS.match(s)
    if s[-1] in "….," and n < 140 and ": " in s and TEASER.match(s):
        return True
    low = s.lower()
    return any(p in low for p in PHRASES) or low.endswith("press desk")


class Lines:
    """``is_link`` with a memory of the lines met; furniture recurs."""

    def __init__(self, most: int = 50_000):
        self.known, self.most = {}, most

    def __call__(self, s: str) -> bool:
        if len(s) > 240:
            return is_link(s)
        k = self.known.get(s)
        if k is None:
            if len(self.known) >= self.most:
                self.known.clear()
            k = self.known[s] = is_link(s)
        return k


def kinds(s: list[str], links: list[bool]) -> list[int | None]:
    """Kind of each stripped line; None for blank ones."""
    n = len(s)
    out: list[int | None] = [None] * n
    prev = before = None  # index of the last line of prose, kind of the last line
    final = max((i for i in range(n) if s[i]), default=-1)
    for i in range(n):
        x = s[i]
        if not x:
            continue
        before = next((out[j] for j in range(i - 1, -1, -1) if out[j] is not None), None) if i == final else None
        if links[i]:
            out[i] = LINK
            continue
        if len(x) < 160 and x.endswith((" Co.", " Inc.", " Corp.", " Ltd.")) and headline_case(x[:-1]) and not (i == final and before == PROSE):
            out[i] = LINK  # a title that ends in an abbreviation
            continue
        if ends(x) or x[-1] == "…":
            out[i] = PROSE
            prev = i
            continue
        # an open end: a line of a wrapped paragraph, a cut text, a heading or a teaser
        nxt = s[i + 1] if i + 1 < n and not links[i + 1] else ""
        wrapped = (i > 0 and prev == i - 1 and not ends(s[i - 1]) and len(s[i - 1]) > 40) or nxt[:1].islower()
        # the line before was full and this continues at its width
        if wrapped or x[:1].islower() or (len(x) > 45 and not headline_case(x)) or DATELINE.match(x):
            out[i] = PROSE
            prev = i
        elif headline_case(x) and not BULLET.match(x) and not (i == final and before == PROSE):
            out[i] = LINK
        else:
            out[i] = HEAD
    return out


def runs_of(k: list[int | None]) -> list[list[int]]:
    """Maximal runs of lines of one kind; a blank line ends a run of links or headings only."""
    runs: list[list[int]] = []
    last = None
    for i, x in enumerate(k):
        if x is None:
            if last != PROSE:
                last = None
            continue
        if x == last:
            runs[-1].append(i)
        else:
            runs.append([i])
        last = x
    return runs


def blocks(k: list[int | None]) -> list[list[int]]:
    """The containers: lines of any kind between blank ones."""
    out: list[list[int]] = [[]]
    for i, x in enumerate(k):
        if x is not None:
            out[-1].append(i)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def points(lines: list[str], k: list[int | None], block: list[int]) -> float:
    """Points of a container's prose for length and commas, less the share of its characters in link-like lines."""
    score, chars, linked = 0.0, 0, 0
    for i in block:
        c = len(lines[i])
        chars += c
        if k[i] == LINK:
            linked += c
        elif k[i] == PROSE:
            score += 1 + lines[i].count(",") + min(c / 100, 3)
    return score * (1 - linked / chars)


def site_lines(lines: list[str], links: list[bool]) -> list[int]:
    """Numbers (from 1) of the stripped lines that aren't part of the release."""
    k = kinds(lines, links)
    # prose in a container without the points is furniture as the links around it are
    begun = False
    for block in blocks(k):
        if points(lines, k, block) >= LEAST_POINTS:
            begun = True
            continue
        # the release may end, before any link, in a line that the links directly follow, and begin after them by its dateline
        ends_here = begun
        for i in block:
            if k[i] == PROSE and not ends_here and not DATELINE.match(lines[i]):
                k[i] = LINK
            elif k[i] == LINK:
                ends_here = False
    runs = runs_of(k)
    keep = [k[run[0]] == PROSE for run in runs]
    # headings stay where the release goes on around them; a run of many short labels is a menu
    for j, run in enumerate(runs):
        if k[run[0]] != HEAD:
            continue
        # (a bare name or place before a quotation is one, too)
        before, after = any(keep[:j]), any(keep[j + 1 :])
        known = all(HEADS.match(lines[i]) for i in run)
        # the next container is prose: the heading opens it; the last line of all may be a cut one
        opens = j + 1 < len(runs) and keep[j + 1]
        cut = j == len(runs) - 1 and before and len(run) == 1 and (keep[j - 1] or len(runs[j - 1]) == 1)
        keep[j] = known and (before or after) or len(run) <= 2 and before and opens or cut
    kept = {i for ok, run in zip(keep, runs) if ok for i in run}
    return [i + 1 for i, x in enumerate(k) if x is not None and i not in kept]
