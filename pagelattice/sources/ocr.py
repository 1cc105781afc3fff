"""Recognisers of text in pictures of boxes, each where its package is installed, behind one interface; models are loaded once per worker."""

from __future__ import annotations

import importlib.util
import io
import os
import shutil
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Page modes of the recogniser for tiny and other boxes, those with a + for short tokens of these characters only; enlargements; block and offset of the adaptive threshold.
MODES = {("quick", True): ["7", "8+", "13+"], ("quick", False): ["6", "7"], ("second", True): ["7"], ("second", False): ["7", "6"]}
VARIANTS = {"quick": ["plain", "otsu_dilated"], "fallback": ["adaptive_dilated"], "second": ["adaptive", "enlarged_otsu"]}
SHORT_TOKENS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=/._-"
TINY_SCALE, SECOND_SCALE = 1.45, 1.35
BLOCK, OFFSET, SIGMA = 11, 2, 2.0


@lru_cache(1)
def tesseract() -> Callable[[object], tuple[str, float]]:
    import pytesseract

    def read(picture) -> tuple[str, float]:
        found = pytesseract.image_to_data(picture, output_type=pytesseract.Output.DICT)
        words = [(w, float(c)) for w, c in zip(found["text"], found["conf"], strict=True) if w.strip() and float(c) >= 0]
        return " ".join(w for w, _ in words), sum(c for _, c in words) / len(words) / 100 if words else 0.0

    return read


@lru_cache(1)
def easyocr() -> Callable[[object], tuple[str, float]]:
    import easyocr as package

    reader = package.Reader(["en"], gpu=False)

    def read(picture) -> tuple[str, float]:
        found = reader.readtext(np.asarray(picture))
        return " ".join(x[1] for x in found), sum(x[2] for x in found) / len(found) if found else 0.0

    return read


@lru_cache(1)
def trocr() -> Callable[[object], tuple[str, float]]:
    from transformers import TrOCRProcessor, VisionEncoderDecoderModel

    name = os.environ.get("TROCR_MODEL", "microsoft/trocr-base-printed")
    processor, model = TrOCRProcessor.from_pretrained(name), VisionEncoderDecoderModel.from_pretrained(name)

    def read(picture) -> tuple[str, float]:
        ids = model.generate(processor(images=picture, return_tensors="pt").pixel_values)
        return processor.batch_decode(ids, skip_special_tokens=True)[0], 0.0

    return read


ENGINES = {"tesseract": tesseract, "easyocr": easyocr, "trocr": trocr}


def available(engine: str) -> bool:
    if engine == "tesseract":
        return shutil.which("tesseract") is not None and importlib.util.find_spec("pytesseract") is not None
    return importlib.util.find_spec({"easyocr": "easyocr", "trocr": "transformers"}[engine]) is not None


def read_boxes(boxes: DataFrame, engine: str, reader: Callable[[object], tuple[str, float]] | None = None) -> DataFrame:
    """boxes: doc_id, page, box_seq, picture (the box as PNG bytes). Adds text and conf. reader: another recogniser, from a picture to text and confidence."""
    if reader is None and not available(engine):
        raise ImportError(f"{engine} is not installed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader or _on_image(ENGINES[engine]())
        for b in batches:
            found = [read(p) for p in b.column("picture").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "page", "box_seq")), pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.float64())], names=["doc_id", "page", "box_seq", "text", "conf"])

    return boxes.select("doc_id", "page", "box_seq", "picture").mapInArrow(run, "doc_id string, page int, box_seq int, text string, conf double")


def _on_image(read: Callable) -> Callable[[bytes], tuple[str, float]]:
    from PIL import Image

    return lambda png: read(Image.open(io.BytesIO(png)))


def otsu(gray: np.ndarray) -> np.ndarray:
    """Black and white by the threshold that separates the two classes of grey best."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below))
    return np.where(gray > int(np.nanargmax(np.where(np.isfinite(between), between, -1.0))), 255, 0).astype(np.uint8)


def adaptive(gray: np.ndarray) -> np.ndarray:
    """Black where a pixel is darker than its neighbourhood, weighted by a bell curve, less the offset."""
    bell = np.exp(-((np.arange(BLOCK) - BLOCK // 2) ** 2) / (2 * SIGMA**2))
    mean = np.pad(gray.astype(float), BLOCK // 2, mode="edge")
    for axis in (0, 1):
        mean = np.apply_along_axis(np.convolve, axis, mean, bell / bell.sum(), "valid")
    return np.where(gray > np.rint(mean) - OFFSET, 255, 0).astype(np.uint8)


def dilated(image: np.ndarray) -> np.ndarray:
    """The lightest of each pixel and its neighbours above and to the left."""
    p = np.pad(image, ((1, 0), (1, 0)), mode="edge")
    return np.maximum.reduce([p[1:, 1:], p[:-1, 1:], p[1:, :-1], p[:-1, :-1]])


def _tesseract_attempt(picture: bytes, variant: str, mode: str, tiny: bool) -> tuple[str, float]:
    import pytesseract
    from PIL import Image

    image = Image.open(io.BytesIO(picture)).convert("L")
    scale = SECOND_SCALE if variant == "enlarged_otsu" else TINY_SCALE if tiny and variant != "adaptive" else 1.0
    if scale != 1.0:
        image = image.resize((round(image.width * scale), round(image.height * scale)), Image.Resampling.BICUBIC)
    gray = np.asarray(image)
    if "otsu" in variant:
        gray = otsu(gray)
    if "adaptive" in variant:
        gray = adaptive(gray)
    if "dilated" in variant:
        gray = dilated(gray)
    config = f"--psm {mode.rstrip('+')} --oem 3" + (f" -c tessedit_char_whitelist={SHORT_TOKENS}" if mode.endswith("+") else "")
    found = pytesseract.image_to_data(Image.fromarray(gray), config=config, output_type=pytesseract.Output.DICT)
    words = [(w.strip(), float(c)) for w, c in zip(found["text"], found["conf"], strict=True) if w.strip()]
    sure = [c for _, c in words if c >= 0]
    return " ".join(w for w, _ in words), round(sum(sure) / len(sure), 2) if sure else 0.0


def read_attempts(boxes: DataFrame, kind: str, reader: Callable[[bytes, str, str, bool], tuple[str, float]] | None = None) -> DataFrame:
    """boxes(doc_id, page, box_seq, tiny, picture): a row (doc_id, page, box_seq, cand_seq, text, conf from 0 to 100) for each attempt, `quick` or `second`, that has a text.

    Quick attempts fall back on an adaptive threshold where none has one. An attempt that raises counts as one without a text, as does a null picture.
    reader: another recogniser, from picture, variant, page mode and tiny to text and confidence.
    """
    if reader is None and not available("tesseract"):
        raise ImportError("tesseract is not installed")
    read = reader or _tesseract_attempt

    def tried(picture: bytes, variants: list[str], modes: list[str], tiny: bool) -> Iterator[tuple[str, float]]:
        for v in variants:
            for m in modes:
                try:
                    text, conf = read(picture, v, m, tiny)
                except Exception:  # a picture that cannot be read is no reason to lose the page
                    continue
                if text and text.strip():
                    yield text, conf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, (small, picture) in enumerate(zip(b.column("tiny").to_pylist(), b.column("picture").to_pylist(), strict=True)):
                modes = MODES[kind, bool(small)]
                found = [] if picture is None else list(tried(picture, VARIANTS[kind], modes, bool(small)))
                if picture is not None and not found and kind == "quick":
                    found = list(tried(picture, VARIANTS["fallback"], modes[:1], bool(small)))
                for k, (text, conf) in enumerate(found):
                    for c, v in zip(out, (i, k, text, conf), strict=True):
                        c.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("doc_id", "page", "box_seq")), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], names=["doc_id", "page", "box_seq", "cand_seq", "text", "conf"])

    return boxes.select("doc_id", "page", "box_seq", "tiny", "picture").mapInArrow(run, "doc_id string, page int, box_seq int, cand_seq int, text string, conf double")
