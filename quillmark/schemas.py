"""Declared schemas of the tables and files that the library reads."""

from pyspark.sql import types as T

_s, _i, _l, _d, _b, _t = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


CANDIDATE = _schema(label=_s, confidence=_d)
BATCHES = _schema(id=_l, batch_id=_s, title=_s, filename=_s, total_pages=_i, transcript_text=_s, confidence_avg=_d, created_at=_t, saved_location=_s, upload_status=_s, is_deleted=_b)
PAGES = _schema(
    page_id=_l, batch_id=_s, page_number=_i, raw_text=_s, raw_transcript_text=_s, edited_text=_s, confidence=_d, image_path=_s, segmentation_image_path=_s,
    rows_detected=_i, words_detected=_i, low_confidence_words=_i, review_notes=_s, is_edited=_b, is_deleted=_b,
)
WORDS = _schema(page=_l, line_index=_i, word_index=_i, text=_s, confidence=_d, raw_text=_s, raw_confidence=_d, top5=T.ArrayType(CANDIDATE), needs_review=_b, review_reason=_s, selected_by_context=_b, skipped=_b, skip_reason=_s)
LINE_BOXES = _schema(line_index=_i, x=_i, y=_i, w=_i, h=_i)
WORD_BOXES = _schema(line_index=_i, word_index=_i, x=_i, y=_i, w=_i, h=_i)
EXPECTED = _schema(pages=T.ArrayType(_schema(page=_i, lines=T.ArrayType(_s))))
PREDICTIONS = _schema(no=_i, image_file=_s, true_label=_s, predicted_label=_s, confidence_percent=_s, top1_result=_s, top5_result=_s, remarks=_s)
ARRIVALS = _schema(event_id=_l, ts=T.TimestampType(), user_id=_l, event_type=_s, value=_d, props=_s)
