"""Conversion options: driver-side scalars, used as literals in plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Names and defaults are a public contract (fixed values), by stage."""

    # what is read
    ocr: str = "auto"
    ocr_lang: str = "por+eng"
    ocr_dpi: int = 300
    keep_images: bool = True
    # what becomes of it
    footnotes: str = "end"
    title: str | None = None
    author: str | None = None
    # how it is written
    lang: str = "pt-BR"
    title_page: bool = True
    toc: bool = True
    page_break_chapters: bool = True
    justify: bool = True
    line_spacing: float = 1.15
    body_pt: float = 12.0
    font: str = "Georgia"
    #: Running lines stand on at least this share of a book's pages.
    running_share: float = 0.35
    #: Place figures by paragraph numbers taken before any paragraph is dropped
    #: or merged, so that they drift towards the end, as older results have them.
    compat_image_anchor: bool = False

    def __post_init__(self) -> None:
        if self.footnotes not in ("end", "inline", "drop"):
            raise ValueError(f"footnotes must be end, inline or drop, not {self.footnotes!r}")
        if self.ocr not in ("auto", "force", "off"):
            raise ValueError(f"ocr must be auto, force or off, not {self.ocr!r}")
