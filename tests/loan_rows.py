"""Literal loan rows of the tests."""

TRAIN_ROWS = [
    (1, 27, 41200, "RENT", 4.0, "PERSONAL", "A", 7300, 7.4, 0.17, "Y", 6, 1),
    (2, 38, 68900, "MORTGAGE", 9.0, "EDUCATION", "B", 12400, 10.2, 0.18, "N", 11, 0),
    (3, 52, 93500, "OWN", 17.0, "MEDICAL", "C", 18600, 12.9, 0.2, "N", 21, 0),
]
TEST_ROWS = [
    (1, 33, 57400, "RENT", 6.0, "PERSONAL", None, 9100, 8.8, 0.16, "N", 7, None),
    (2, 47, 79300, "MORTGAGE", 13.0, "EDUCATION", None, 14700, 11.6, 0.19, "Y", 16, None),
]
NULL_ROWS = [
    (1, None, 41200, "RENT", None, "PERSONAL", "A", 7300, 7.4, 0.17, "Y", 6, 1),
    (2, 38, None, "MORTGAGE", 9.0, None, "B", 12400, None, 0.18, "N", None, 0),
]
