"""leafmill: document-reflow analytics on Spark DataFrames.

Positioned spans, lines, blocks and pages of many books at once become
paragraphs, headings, lists, notes and rendered e-books.  Everything is a
``DataFrame -> DataFrame`` function; order is always carried in ``*_seq``
columns, and ``book_id`` leads every key.
"""

__version__ = "0.1.0"
