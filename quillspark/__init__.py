"""quillspark: meeting-transcript, signal and text analytics expressed as Spark jobs."""
