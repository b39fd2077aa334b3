"""The histogram and moment operators on streams."""
