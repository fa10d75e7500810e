"""quillspark.plans"""
