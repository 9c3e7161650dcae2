"""Declared schemas. ``ord`` carries the order of a source; no operator relies on any other order."""

CORPUS = (
    "id string, chapter string, text string, raw_text string, source string, year int, school string, level string, exam string, "
    "paper string, question_no string, modified boolean, marks int, topic string, section string, subsection string, page int, source_file string"
)
LINE = "paper_id string, ord long, page int, page_height double, x0 double, y0 double, x1 double, y1 double, size double, text string"
QUESTION = "paper_id string, number int, start_page int, pages array<int>, text string"
REPORT = (
    "paper_id string, rung int, questions int, highest_number int, missing_numbers array<int>, duplicated_numbers array<int>, "
    "oversized_questions array<struct<number:int,pages:array<int>>>, empty_questions array<int>, pages_read array<int>, "
    "pages_without_text_layer array<int>, question_column double, column_slope double, problems array<string>, trustworthy boolean"
)
RUN = (
    "approach string, seed int, predicted array<string>, test_hash string, test_rows int, train_seconds double, parameters bigint, "
    "hardware string, recorded string, method string, features int, conditions struct<class_weights:boolean,max_tokens:int>, fraction double, train_rows int"
)
PREDICTION = "ord long, y_true string, predicted string, confidence double"
TRUTH = "map<string,struct<pdf:string,label:string,held_out:boolean,pages:array<int>,note:string,questions:array<struct<n:int,pages:array<int>>>>>"
