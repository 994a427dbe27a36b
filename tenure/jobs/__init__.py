"""Jobs with several outputs, each written once."""
