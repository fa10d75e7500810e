"""quillspark.functions"""
