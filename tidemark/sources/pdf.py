"""PDF text through whichever reader is installed on the executors.

No PDF library is a dependency of this package. A caller may also hand in any
function ``bytes -> str``.
"""

from __future__ import annotations

from collections.abc import Callable

PdfReader = Callable[[bytes], str]


class EncryptedPdfError(ValueError):
    pass


def _with_pymupdf(content: bytes) -> str:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        if pdf.is_encrypted:
            raise EncryptedPdfError("Encrypted PDF is not supported")
        return "\n\n".join(page.get_text("text") for page in pdf)


def _with_pypdf(content: bytes) -> str:
    import io

    import pypdf

    pdf = pypdf.PdfReader(io.BytesIO(content))
    if pdf.is_encrypted:
        raise EncryptedPdfError("Encrypted PDF is not supported")
    return "\n\n".join(page.extract_text() for page in pdf.pages)


def installed_pdf_text(content: bytes) -> str:
    """Page texts joined by a blank line; an encrypted file is an error."""
    for read in (_with_pymupdf, _with_pypdf):
        try:
            return read(content)
        except ModuleNotFoundError:
            continue
    raise RuntimeError("No PDF backend: install a PDF library on the executors or pass pdf_reader.")
