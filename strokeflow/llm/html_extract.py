"""HTML extraction: flat text blocks, classified by a decision tree over word counts and link densities of neighbours.

A page becomes a flat list of text blocks. Each block has its own and its
neighbours' word count and link density, the share of the page's plain words
that its container holds and that main parts beside it hold, and whether a container says that it is a menu, an
advert and so on, or an article. A decision tree, grown by Gini impurity from
the small labelled table below, keeps or drops it. Names are whole words of a
class, or the first or last part of a compound (nav-wrapper, cookie-bar).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

# Names of elements and of containers, as pages use them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style title textarea noscript template iframe object svg math canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLUTTER_TAGS = frozenset("nav header footer aside form menu dialog button select label head".split())
MAIN_TAGS = frozenset("article main".split())
#: Elements whose names say what is in them (has-sidebar), not what they are.
WHOLE_TAGS = MAIN_TAGS | {"html", "body"}
#: Elements of one block of text; what they stand in holds it.
LEAF_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre caption figcaption legend summary option".split())
WRAPPED_TAGS = MAIN_TAGS | frozenset("div section table".split())
CLUTTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav widget widgets "
    "footer contentinfo masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments "
    "discussion reply replies disqus respond responses login search searchbox pagination pager complementary alert alertdialog dialog copyright disclaimer toolbar outbrain taboola".split()
)
HEADER_WORDS = frozenset("header topbar".split())
MAIN_WORDS = frozenset("article main content entry story post".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^"'>])*+)>|<[/!?][^>]*>?|<[a-zA-Z][^>]*>?|[^<]+|<""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z][\w-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[-_]+")
#: First parts of compounds that say what an element has, not what it is.
HAS_WORDS = frozenset("has is no not with without".split())

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "share", "main_beside", "clutter", "in_main", "heading")

#: The labelled table: FEATURES, then 1 to keep. Written by hand from the kinds of blocks that pages have.
LABELLED = [
    # words, density, before: words, density, after: words, density, share, main_beside, clutter, in_main, heading, keep
    (1, 1.0, 0, 0.0, 1, 1.0, 0.0, 0.8, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0.01, 0.0, 1, 0, 0, 0),
    (2, 1.0, 1, 1.0, 9, 0.0, 0.05, 0.3, 1, 0, 0, 0),
    (9, 0.0, 1, 1.0, 11, 0.0, 0.2, 0.0, 1, 0, 0, 0),
    (11, 0.0, 75, 0.0, 0, 0.0, 0.02, 0.8, 1, 0, 0, 0),
    (16, 0.2, 120, 0.0, 0, 0.0, 0.4, 0.0, 1, 0, 0, 0),
    (60, 0.0, 90, 0.0, 40, 0.0, 0.0, 0.0, 1, 1, 0, 0),
    (40, 0.0, 60, 0.0, 35, 0.0, 0.01, 0.0, 1, 1, 0, 0),
    (12, 0.0, 45, 0.1, 30, 0.0, 0.05, 0.0, 1, 1, 0, 0),
    (120, 0.0, 9, 0.0, 80, 0.0, 0.2, 0.3, 1, 0, 0, 0),
    (150, 0.8, 9, 0.0, 80, 0.0, 0.02, 0.0, 1, 0, 0, 0),
    (160, 0.7, 5, 0.0, 60, 0.0, 0.4, 0.8, 1, 0, 0, 0),
    (25, 0.4, 30, 0.0, 20, 1.0, 0.0, 0.0, 1, 0, 0, 0),
    (3, 0.0, 120, 0.0, 50, 0.0, 0.01, 0.0, 1, 1, 1, 0),
    (11, 0.0, 9, 0.0, 75, 0.0, 1.0, 0.0, 0, 1, 1, 1),
    (4, 0.0, 9, 0.0, 4, 0.0, 0.9, 0.0, 0, 1, 1, 1),
    (75, 0.0, 11, 0.0, 8, 0.0, 0.02, 0.0, 0, 1, 0, 1),
    (1, 0.0, 123, 0.0, 9, 0.0, 0.3, 0.0, 0, 1, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0.005, 0.0, 0, 1, 0, 1),
    (9, 0.0, 1, 0.0, 11, 0.0, 0.6, 0.0, 0, 1, 0, 1),
    (30, 0.6, 40, 0.0, 40, 0.0, 0.1, 0.0, 0, 1, 0, 1),
    (5, 1.0, 40, 0.0, 40, 0.0, 1.0, 0.0, 0, 1, 0, 1),
    (400, 0.0, 10, 0.0, 8, 0.0, 0.9, 0.0, 0, 1, 0, 1),
    (8, 0.0, 400, 0.0, 12, 0.0, 0.005, 0.94, 0, 0, 0, 0),
    (30, 0.0, 6, 1.0, 10, 0.0, 0.02, 0.93, 0, 0, 0, 0),
    (90, 0.0, 3, 0.0, 10, 0.0, 0.08, 0.87, 0, 0, 0, 0),
    (6, 1.0, 2, 1.0, 10, 0.0, 0.03, 0.0, 0, 0, 0, 0),
    (5, 0.0, 0, 0.0, 60, 0.0, 0.01, 0.94, 0, 0, 1, 0),
    (60, 0.0, 5, 0.0, 45, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (45, 0.1, 60, 0.0, 3, 1.0, 0.5, 0.0, 0, 0, 0, 1),
    (20, 0.0, 45, 0.0, 70, 0.0, 0.08, 0.0, 0, 0, 0, 1),
    (18, 0.0, 4, 0.0, 30, 0.0, 0.03, 0.0, 0, 0, 0, 1),
    (8, 0.0, 45, 0.0, 70, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (3, 0.0, 30, 0.0, 70, 0.0, 0.2, 0.0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 60, 0.0, 1.0, 0.0, 0, 0, 1, 1),
    (7, 0.0, 30, 0.0, 25, 0.0, 0.5, 0.0, 0, 0, 1, 1),
    (2, 0.0, 3, 0.0, 40, 0.0, 0.08, 0.0, 0, 0, 1, 1),
    (5, 1.0, 4, 1.0, 6, 1.0, 0.0, 0.0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0.0, 0.0, 0, 0, 0, 0),
    (12, 0.9, 5, 1.0, 3, 1.0, 0.0, 0.0, 0, 0, 0, 0),
    (30, 0.8, 4, 1.0, 5, 1.0, 0.02, 0.0, 0, 0, 0, 0),
    (6, 1.0, 60, 0.0, 4, 1.0, 0.0, 0.0, 0, 0, 0, 0),
    (4, 1.0, 45, 0.0, 60, 0.0, 0.0, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 4, 1.0, 0.0, 0.0, 0, 0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 1.0, 0.01, 0.94, 0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0),
    # Clutter, unless it is most of the page.
    (5, 0.0, 20, 0.0, 30, 0.0, 0.05, 0.0, 1, 1, 0, 0),
    (200, 0.0, 60, 0.0, 300, 0.0, 0.2, 0.3, 1, 0, 0, 0),
    (200, 0.0, 60, 0.0, 0, 0.0, 0.02, 0.0, 1, 0, 0, 0),
    (300, 0.0, 0, 0.0, 60, 0.0, 0.4, 0.8, 1, 0, 0, 0),
    (170, 0.1, 5, 0.0, 8, 0.0, 0.0, 0.0, 1, 0, 0, 0),
    (250, 0.0, 300, 0.0, 20, 0.0, 0.01, 0.3, 1, 0, 0, 0),
    (160, 0.0, 20, 1.0, 0, 0.0, 0.05, 0.0, 1, 0, 0, 0),
    (200, 0.0, 60, 0.0, 300, 0.0, 0.8, 0.0, 1, 0, 0, 1),
    (150, 0.1, 5, 0.0, 12, 0.0, 0.7, 0.0, 1, 0, 0, 1),
    (180, 0.0, 0, 0.0, 0, 0.0, 0.7, 0.0, 1, 0, 0, 1),
    (170, 0.0, 40, 0.0, 30, 0.0, 0.7, 0.0, 1, 1, 0, 1),
    (250, 0.1, 70, 0.0, 80, 0.0, 0.8, 0.0, 1, 1, 0, 1),
    (80, 0.1, 20, 0.0, 15, 0.0, 0.2, 0.8, 1, 0, 0, 0),
    (15, 0.0, 5, 0.0, 25, 0.0, 0.02, 0.0, 1, 1, 1, 0),
    (35, 0.0, 2, 0.0, 9, 0.0, 0.4, 0.0, 1, 0, 0, 0),
    (7, 1.0, 8, 1.0, 120, 0.0, 0.0, 0.0, 1, 1, 0, 0),
    # In the main part: all of it.
    (2, 0.0, 60, 0.0, 3, 0.0, 0.02, 0.0, 0, 1, 0, 1),
    (14, 0.0, 1, 1.0, 30, 0.0, 0.3, 0.0, 0, 1, 0, 1),
    (3, 0.0, 1, 1.0, 1, 1.0, 0.005, 0.0, 0, 1, 1, 1),
    (60, 0.0, 3, 1.0, 2, 1.0, 0.6, 0.0, 0, 1, 0, 1),
    (8, 1.0, 6, 1.0, 5, 1.0, 0.1, 0.0, 0, 1, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 1.0, 0.0, 0, 1, 0, 1),
    (150, 0.2, 2, 0.0, 0, 0.0, 0.9, 0.0, 0, 1, 0, 1),
    (25, 0.0, 8, 0.0, 6, 0.0, 0.02, 0.0, 0, 1, 0, 1),
    (10, 0.9, 8, 0.0, 9, 0.0, 0.3, 0.0, 0, 1, 0, 1),
    (50, 0.0, 200, 0.0, 200, 0.0, 0.005, 0.0, 0, 1, 0, 1),
    # Beside a main part: long prose only.
    (180, 0.0, 10, 0.0, 90, 0.0, 0.4, 0.5, 0, 0, 0, 1),
    (150, 0.1, 3, 0.0, 10, 0.0, 0.4, 0.5, 0, 0, 0, 1),
    (300, 0.0, 60, 0.0, 0, 0.0, 0.4, 0.5, 0, 0, 0, 1),
    (180, 0.8, 10, 0.0, 90, 0.0, 0.0, 0.95, 0, 0, 0, 0),
    (150, 0.7, 3, 1.0, 10, 1.0, 0.0, 0.95, 0, 0, 0, 0),
    (70, 0.0, 10, 0.0, 90, 0.0, 0.005, 0.94, 0, 0, 0, 0),
    (40, 0.0, 300, 0.0, 0, 0.0, 0.02, 0.93, 0, 0, 0, 0),
    (12, 0.0, 20, 0.0, 15, 0.0, 0.08, 0.87, 0, 0, 1, 0),
    (200, 0.0, 40, 0.0, 50, 0.0, 0.4, 0.5, 0, 0, 0, 1),
    (3, 0.0, 70, 0.0, 6, 0.0, 0.03, 0.92, 0, 0, 0, 0),
    (25, 0.1, 2, 1.0, 30, 0.1, 0.01, 0.94, 0, 0, 0, 0),
    (5, 1.0, 50, 0.0, 60, 0.0, 0.005, 0.94, 0, 0, 0, 0),
    (18, 0.0, 8, 0.0, 9, 0.0, 0.02, 0.93, 0, 0, 0, 0),
    # Pages whose containers say nothing.
    (14, 0.2, 3, 0.0, 8, 0.0, 0.03, 0.0, 0, 0, 0, 1),
    (11, 0.2, 2, 0.0, 9, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (40, 0.0, 2, 1.0, 30, 0.0, 0.2, 0.0, 0, 0, 0, 1),
    (30, 0.0, 3, 1.0, 0, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (25, 0.3, 12, 0.0, 3, 1.0, 0.5, 0.0, 0, 0, 0, 1),
    (120, 0.0, 0, 0.0, 0, 0.0, 0.08, 0.0, 0, 0, 0, 1),
    (5, 0.0, 14, 0.0, 20, 0.0, 0.03, 0.0, 0, 0, 0, 1),
    (6, 0.0, 12, 0.0, 0, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (4, 0.0, 40, 0.0, 2, 1.0, 0.2, 0.0, 0, 0, 0, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0.5, 0.0, 0, 0, 0, 1),
    (10, 0.8, 30, 0.0, 2, 1.0, 0.04, 0.0, 0, 0, 0, 0),
    (3, 1.0, 20, 0.0, 30, 0.0, 0.0, 0.0, 0, 0, 0, 0),
    (20, 0.9, 20, 0.0, 30, 0.0, 0.0, 0.0, 0, 0, 0, 0),
    (4, 1.0, 0, 0.0, 3, 1.0, 0.0, 0.0, 0, 0, 0, 0),
    (2, 0.0, 3, 1.0, 3, 1.0, 0.02, 0.93, 0, 0, 0, 0),
    # Linked and short paragraphs of a page's one body of text.
    (5, 1.0, 0, 0.0, 3, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (5, 1.0, 9, 0.0, 40, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (4, 1.0, 2, 0.0, 2, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (2, 0.0, 5, 1.0, 0, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (3, 0.0, 6, 1.0, 5, 1.0, 1.0, 0.0, 0, 0, 0, 1),
    (12, 0.9, 8, 0.0, 8, 0.0, 1.0, 0.0, 0, 0, 0, 1),
    (6, 0.0, 0, 0.0, 4, 1.0, 0.9, 0.0, 0, 0, 0, 1),
    (2, 0.0, 4, 1.0, 6, 1.0, 0.6, 0.0, 0, 0, 0, 1),
    (7, 1.0, 30, 0.0, 25, 0.0, 0.6, 0.0, 0, 0, 0, 1),
    (30, 0.0, 60, 0.0, 20, 1.0, 0.12, 0.0, 0, 0, 0, 1),
    (45, 0.0, 45, 0.0, 50, 0.0, 0.1, 0.0, 0, 0, 0, 1),
    (25, 0.0, 60, 0.0, 45, 0.0, 0.06, 0.0, 0, 0, 0, 1),
    (8, 0.0, 60, 0.0, 45, 0.0, 0.05, 0.0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 60, 0.0, 0.03, 0.0, 0, 0, 0, 1),
    (4, 0.0, 2, 0.0, 80, 0.0, 0.04, 0.0, 0, 0, 1, 1),
    (5, 0.0, 1, 1.0, 12, 0.0, 0.02, 0.93, 0, 0, 0, 0),
    (9, 0.0, 80, 0.0, 2, 1.0, 0.02, 0.93, 0, 0, 0, 0),
    (14, 0.0, 70, 0.0, 0, 0.0, 0.03, 0.92, 0, 0, 0, 0),
    (8, 0.0, 200, 0.0, 0, 0.0, 0.02, 0.93, 0, 0, 0, 0),
    # In the main part, whatever surrounds it.
    (2, 1.0, 2, 1.0, 2, 1.0, 0.01, 0.0, 0, 1, 0, 1),
    (6, 1.0, 3, 0.0, 20, 0.0, 0.03, 0.0, 0, 1, 0, 1),
    (30, 1.0, 0, 0.0, 3, 1.0, 0.02, 0.0, 0, 1, 0, 1),
    (12, 0.8, 2, 1.0, 2, 1.0, 0.5, 0.0, 0, 1, 0, 1),
    (40, 0.75, 5, 0.0, 40, 0.0, 0.9, 0.0, 0, 1, 0, 1),
    (7, 0.8, 9, 0.0, 6, 0.0, 0.1, 0.0, 0, 1, 0, 1),
    (3, 1.0, 1, 1.0, 30, 0.0, 0.0, 0.0, 0, 1, 1, 1),
    (8, 0.0, 6, 0.0, 8, 0.0, 0.08, 0.0, 0, 1, 1, 1),
    (4, 0.0, 10, 0.0, 12, 0.0, 0.07, 0.0, 0, 1, 0, 1),
    (9, 0.2, 20, 0.0, 3, 0.0, 0.06, 0.0, 0, 1, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 0.09, 0.0, 0, 1, 0, 1),
    (20, 0.0, 5, 0.0, 20, 0.0, 0.08, 0.0, 0, 1, 0, 1),
    (60, 0.0, 20, 0.0, 13, 0.0, 0.07, 0.0, 0, 1, 0, 1),
    (4, 0.0, 1, 0.0, 6, 1.0, 1.0, 0.0, 0, 1, 0, 1),
    (6, 1.0, 4, 0.0, 30, 0.0, 1.0, 0.0, 0, 1, 0, 1),
    (30, 0.0, 6, 1.0, 0, 0.0, 1.0, 0.0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 4, 0.0, 0.3, 0.0, 0, 1, 1, 1),
    (3, 0.0, 9, 1.0, 9, 1.0, 0.05, 0.0, 0, 1, 0, 1),
    (9, 1.0, 9, 1.0, 9, 1.0, 0.02, 0.0, 0, 1, 0, 1),
    (120, 1.0, 3, 1.0, 3, 1.0, 0.05, 0.0, 0, 1, 0, 1),
    (2, 1.0, 200, 0.0, 0, 0.0, 0.01, 0.0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0.01, 0.0, 0, 1, 0, 1),
    (14, 0.5, 0, 0.0, 300, 1.0, 0.1, 0.0, 0, 1, 1, 1),
    (60, 0.7, 5, 1.0, 5, 1.0, 0.0, 0.0, 0, 1, 0, 1),
    (3, 1.0, 12, 0.0, 1, 1.0, 0.0, 0.0, 0, 1, 0, 1),
    # Comments, adverts and footers of short pages.
    (60, 0.0, 40, 0.0, 30, 0.0, 0.5, 0.0, 1, 1, 0, 0),
    (45, 0.1, 60, 0.0, 0, 0.0, 0.45, 0.3, 1, 0, 0, 0),
    (90, 0.0, 300, 0.0, 20, 0.0, 0.3, 0.0, 1, 0, 0, 0),
    (5, 0.0, 1, 1.0, 12, 0.0, 0.5, 0.8, 1, 0, 0, 0),
    (12, 0.0, 75, 0.0, 0, 0.0, 0.35, 0.0, 1, 0, 0, 0),
    # Long clutter, beside a main part that is shorter.
    (200, 0.0, 60, 0.0, 0, 0.0, 0.77, 0.23, 1, 0, 0, 0),
    (150, 0.0, 45, 0.0, 80, 0.0, 0.8, 0.15, 1, 0, 0, 0),
    (90, 0.1, 70, 0.0, 0, 0.0, 0.65, 0.35, 1, 0, 0, 0),
    (300, 0.0, 100, 0.0, 12, 0.0, 0.7, 0.3, 1, 0, 0, 0),
]


def grow(rows: list[tuple], depth: int = 8) -> tuple | int:
    """A decision tree: a class, or (feature, threshold, tree where at most the threshold, tree where more)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def gini(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            left, right = [r for r in rows if r[f] <= at], [r for r in rows if r[f] > at]
            cost = gini(left) + gini(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, at, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _names(value: str) -> set[str]:
    """Whole words of a class, and first and last parts of compounds."""
    names = set()
    for word in value.split():
        parts = [p for p in _PARTS.split(word) if p]
        names.add(word)
        if len(parts) > 1 and parts[0] not in HAS_WORDS:
            names |= {parts[0], parts[-1]}
    return names


def _kind(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether a container is surely clutter, and whether it says that it is clutter, a header, a main part."""
    sure, header, main = tag in CLUTTER_TAGS and tag not in ("header", "form"), tag == "header", tag in MAIN_TAGS
    said = tag == "form"
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role", "aria-label"):
                names = _names(value)
                if tag not in WHOLE_TAGS:
                    said |= bool(names & CLUTTER_WORDS)
                    header |= bool(names & HEADER_WORDS) or (name == "role" and "banner" in names)
                main |= bool(names & MAIN_WORDS) and tag in ("div", "section", "td", "main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                sure = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                sure = True
    return sure, said, header, main and not sure and not said


def _resolve(inside: list[tuple[int, bool, bool, bool, bool]], wraps: set[int], leaves: set[int], found: list[tuple]) -> tuple[list[bool], list[bool], list[float], float]:
    """Whether each container is clutter, whether in the main part, with what the outer ones are, and what share of the page's plain words it holds; then the share of all main parts.

    ``inside`` has a container's outer one, which comes before it, and its kind;
    ``found`` has blocks as (text, words, words in links, container, heading). A
    container that says it is clutter but wraps most of the page, with next to
    no main part elsewhere, is not clutter. A page has a main part if its
    main containers hold most of its text that is not clutter. Plain words are
    those outside links; what a main part holds does not count for the
    containers around it.
    """
    n = len(inside)

    def settle(wrappers: set[int], with_main: bool) -> tuple[list[bool], list[bool]]:
        clutter, in_main = [False] * n, [False] * n
        for i in range(1, n):
            outer, sure, said, header, main = inside[i]
            own = sure or (said and i not in wrappers) or (header and not in_main[outer])
            clutter[i], in_main[i] = clutter[outer] or own, in_main[outer] or (with_main and main)
        return clutter, in_main

    def held(counts) -> list[int]:
        total = [0] * n
        for of, words in counts:
            total[of] += words
        for i in range(n - 1, 0, -1):
            total[inside[i][0]] += total[i]
        return total

    wrappers = {i for i in wraps if inside[i][2]}
    if wrappers:
        # Text that is clutter by no more than what wrappers say.
        clutter, in_main = settle(wrappers, True)
        plain = [(b[3], b[1]) for b in found if not clutter[b[3]]]
        text, main = held(plain), held((c, w) for c, w in plain if in_main[c])
        wrappers = {i for i in wrappers if 2 * text[i] > text[0] and 10 * (main[0] - main[i]) <= text[i]}
    clutter, in_main = settle(wrappers, True)
    words = sum(b[1] for b in found if not clutter[b[3]])
    if 2 * sum(b[1] for b in found if not clutter[b[3]] and in_main[b[3]]) <= words:
        clutter, in_main = settle(wrappers, False)
    holder = list(range(n))
    for i in sorted(leaves):
        holder[i] = holder[inside[i][0]]
    plain = [0] * n
    for b in found:
        plain[holder[b[3]]] += b[1] - b[2]
    whole = max(1, sum(plain))
    in_mains = sum(x for x, main in zip(plain, in_main) if main)
    for i in range(n - 1, 0, -1):
        if in_main[inside[i][0]] or not in_main[i]:
            plain[inside[i][0]] += plain[i]
    return clutter, in_main, [plain[i] / whole for i in holder], in_mains / whole


def blocks(html: str) -> list[tuple[str, int, int, float, float, bool, bool, bool]]:
    """(text, words, words in links, share, main_beside, clutter, in_main, heading) of each block with text, in page order."""
    out: list[tuple] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = [("", 0)]  # tag, container
    inside: list[tuple] = [(0, False, False, False, False)]  # of each container: the outer one, and its kind
    wraps: set[int] = set()  # containers with further ones for text
    leaves: set[int] = set()
    link = heading = False

    def close_block() -> None:
        nonlocal heading
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                in_links = len(unescape("".join(linked)).split())
                out.append((text, text.count(" ") + 1, in_links, stack[-1][1], heading))
            parts.clear()
            linked.clear()
        heading = False

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            got = m[0]
            if got[0] != "<" or got == "<":
                parts.append(got)
                if link:
                    linked.append(got)
            continue
        tag, closing, attrs = tag.lower(), bool(m["close"]), m["attrs"]
        if tag in RAW and not closing:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            if tag in BLOCK:
                close_block()
            continue
        if tag == "a":
            link = not closing
            linked.append(" ")
        elif tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            close_block()
            if tag not in ("p", "li"):
                link = False
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK:
                        close_block()
                    del stack[i:]
                    break
        elif tag not in VOID and tag not in ("p", "a", "br"):
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack[-1][0] == tag:
                stack.pop()
            kind = _kind(tag, attrs)
            if tag in BLOCK or any(kind[:3]):
                if tag not in BLOCK:
                    close_block()
                if tag in WRAPPED_TAGS:
                    wraps.add(stack[-1][1])
                inside.append((stack[-1][1], *kind))
                if tag in LEAF_TAGS:
                    leaves.add(len(inside) - 1)
                stack.append((tag, len(inside) - 1))
            if tag[0] == "h" and tag[1:].isdigit():
                heading = True
        elif tag == "p" and attrs:
            sure, said, _, _ = _kind(tag, attrs)
            if sure or said:
                inside.append((stack[-1][1], sure, said, False, False))
                leaves.add(len(inside) - 1)
                stack.append(("p", len(inside) - 1))
        if tag == "p" and not closing and not attrs and stack[-1][0] == "p":
            stack.pop()
    close_block()
    clutter, in_main, share, mains = _resolve(inside, wraps, leaves, out)
    return [(text, words, in_links, share[of], 0.0 if in_main[of] else mains, clutter[of], in_main[of], heading) for text, words, in_links, of, heading in out]


def extract(html: str | None, tree: tuple | int) -> str:
    found = blocks(html or "")
    around = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    kept = []
    for i, (text, words, in_links, *rest) in enumerate(found):
        row = (words, in_links / words, *around[i], *around[i + 2], *rest)
        if decide(tree, row):
            kept.append(text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """``pages`` (html and anything else but ``text``, ``n_chars``, which are replaced) with the main ``text`` and its ``n_chars`` in code points.

    Null or empty pages, and pages without a block to keep, give an empty text.
    Character references are decoded once, white space inside a block becomes
    one space, blocks are trimmed and joined by a newline. Unclosed and cut-off
    markup is read as browsers do: what can still be text is text. Pages are
    read whole, one at a time.
    """
    tree = grow(labelled or LABELLED)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([extract(h, tree) for h in htmls], dtype=object)

    return pages.drop("text", "n_chars").withColumn("text", text(F.col("html").cast("string"))).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
