"""Inputs and outputs: campaign files, stored datasets, the campaign catalog, made-up campaigns."""
