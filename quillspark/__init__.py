"""quillspark: DataFrame operators for condensing and analysing developer-session text."""
