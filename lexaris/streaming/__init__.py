"""Online classification of whole documents with a static model."""
