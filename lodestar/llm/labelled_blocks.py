"""The small labelled table of the block classifier: one row a text block of hand-made pages that do not mark their article.

Numbers: words and link density of the block, of the one before and of the one after it; last, whether the block is main text.
"""

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after")

LABELLED = (
    # A page without an article: menu of links, headline, paragraphs, a list, links below, a line at the end.
    (1, 1.0, 0, 0.0, 1, 1.0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 0),
    (1, 1.0, 2, 1.0, 3, 1.0, 0),
    (3, 1.0, 1, 1.0, 8, 0.0, 0),
    (8, 0.0, 3, 1.0, 55, 0.0, 1),
    (55, 0.0, 8, 0.0, 33, 0.1, 1),
    (33, 0.1, 55, 0.0, 5, 0.0, 1),
    (5, 0.0, 33, 0.1, 140, 0.0, 1),
    (140, 0.0, 5, 0.0, 4, 0.0, 1),
    (4, 0.0, 140, 0.0, 6, 0.0, 1),
    (6, 0.0, 4, 0.0, 7, 0.0, 1),
    (7, 0.0, 6, 0.0, 26, 0.2, 1),
    (26, 0.2, 7, 0.0, 12, 0.9, 1),
    (12, 0.9, 26, 0.2, 10, 0.8, 0),
    (10, 0.8, 12, 0.9, 7, 0.7, 0),
    (7, 0.7, 10, 0.8, 2, 1.0, 0),
    (2, 1.0, 7, 0.7, 5, 0.0, 0),
    (5, 0.0, 2, 1.0, 0, 0.0, 0),
    # Another one: a line of links, a short headline, a date, prose with links, a caption, links between prose.
    (9, 0.9, 0, 0.0, 3, 0.0, 0),
    (3, 0.0, 9, 0.9, 52, 0.05, 1),
    (52, 0.05, 3, 0.0, 31, 0.3, 1),
    (31, 0.3, 52, 0.05, 18, 0.0, 1),
    (18, 0.0, 31, 0.3, 2, 0.0, 1),
    (2, 0.0, 18, 0.0, 90, 0.1, 1),
    (90, 0.1, 2, 0.0, 11, 0.0, 1),
    (11, 0.0, 90, 0.1, 75, 0.0, 1),
    (75, 0.0, 11, 0.0, 1, 1.0, 1),
    (1, 1.0, 75, 0.0, 1, 1.0, 0),
    (1, 1.0, 1, 1.0, 4, 1.0, 0),
    (4, 1.0, 1, 1.0, 6, 0.0, 0),
    (6, 0.0, 4, 1.0, 3, 1.0, 0),
    (3, 1.0, 6, 0.0, 8, 0.0, 0),
    (8, 0.0, 3, 1.0, 0, 0.0, 0),
    # Lists of links with short text between: a front page.
    (6, 1.0, 5, 1.0, 4, 0.0, 0),
    (4, 0.0, 6, 1.0, 7, 1.0, 0),
    (7, 1.0, 4, 0.0, 3, 0.0, 0),
    (3, 0.0, 7, 1.0, 9, 1.0, 0),
    (9, 1.0, 3, 0.0, 16, 0.6, 0),
    (16, 0.6, 9, 1.0, 2, 0.5, 0),
    (2, 0.0, 16, 0.6, 5, 1.0, 0),
    (25, 0.8, 2, 1.0, 30, 0.7, 0),
    (30, 0.7, 25, 0.8, 14, 0.9, 0),
    # A shop's page: names and prices between links, labels, dates, counts.
    (2, 0.0, 3, 1.0, 1, 0.0, 0),
    (1, 0.0, 2, 0.0, 4, 1.0, 0),
    (4, 0.0, 4, 1.0, 2, 1.0, 0),
    (1, 0.0, 5, 1.0, 3, 1.0, 0),
    (3, 0.0, 2, 1.0, 6, 0.8, 0),
    (2, 0.0, 8, 0.9, 3, 1.0, 0),
    (1, 0.0, 1, 1.0, 2, 1.0, 0),
    (5, 0.0, 4, 0.9, 1, 1.0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0),
    (3, 0.0, 3, 1.0, 4, 1.0, 0),
    (1, 0.0, 6, 1.0, 0, 0.0, 0),
    (4, 0.0, 2, 1.0, 7, 1.0, 0),
    (2, 0.3, 2, 1.0, 5, 1.0, 0),
    (6, 0.2, 5, 1.0, 1, 1.0, 0),
    # Prose of pages without an article.
    (44, 0.0, 38, 0.1, 61, 0.0, 1),
    (61, 0.05, 44, 0.0, 29, 0.0, 1),
    (29, 0.0, 61, 0.05, 85, 0.2, 1),
    (85, 0.2, 29, 0.0, 47, 0.0, 1),
    (47, 0.0, 85, 0.2, 2, 1.0, 1),
    (36, 0.0, 4, 1.0, 58, 0.0, 1),
    (58, 0.1, 36, 0.0, 3, 1.0, 1),
    (72, 0.0, 1, 1.0, 41, 0.0, 1),
    # Short pages of bare text.
    (3, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 1),
    (40, 0.1, 0, 0.0, 0, 0.0, 1),
    (4, 0.0, 0, 0.0, 6, 0.0, 1),
    (6, 0.0, 4, 0.0, 0, 0.0, 1),
    (5, 0.0, 60, 0.0, 0, 0.0, 1),
    (2, 0.0, 25, 0.0, 0, 0.0, 1),
    # Headlines between a menu and prose.
    (1, 0.0, 1, 1.0, 40, 0.0, 1),
    (2, 0.0, 3, 1.0, 55, 0.0, 1),
    (1, 0.0, 2, 1.0, 31, 0.0, 1),
    (3, 0.0, 5, 0.9, 70, 0.1, 1),
    (4, 0.0, 1, 1.0, 28, 0.0, 1),
    (6, 0.0, 2, 1.0, 36, 0.0, 1),
    # A page of one paragraph under a menu; prose between lists of links; a list of links of a page of links.
    (30, 0.0, 1, 1.0, 0, 0.0, 1),
    (18, 0.0, 4, 1.0, 4, 1.0, 1),
    (26, 0.1, 2, 1.0, 0, 0.0, 1),
    (8, 1.0, 30, 0.0, 8, 1.0, 0),
    (8, 1.0, 8, 1.0, 0, 0.0, 0),
    (2, 1.0, 26, 0.1, 0, 0.0, 0),
)
